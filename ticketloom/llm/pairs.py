"""Defective prompt and response pairs.

Copies are found by the share of the response's shingles that the prompt
contains and by their longest common subsequence. For refusals every sentence
of a response is written as the kinds of its words (denial, ability, act of
answering, its object, speaker...) and aligned to templates of such kinds, so
a refusal is known by what it says and not by its wording. Other languages are
told by the compression costs of problem 4.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.language import COMMON, Judge, dictionaries
from ticketloom.llm.residue import plain
from ticketloom.session import written

#: Words of a shingle; share of the response's shingles, and of its words in common order, that make a copy.
SHINGLE = 3
CONTAINED = 0.5
COMMON_ORDER = 0.7
#: Words from which an incomplete copy is one.
PARTIAL = 6
#: Share of a declining sentence's words that may be of no kind.
UNRELATED = 0.25
#: Bytes by which the languages of a prompt and of its response must win to be compared.
FOREIGN_BYTES = 4
#: Strings of which a worker keeps the words; when there are more, it begins anew.
KEPT = 200_000

# Words that stand for nothing.
NOTHING = frozenset("n a na nan nil none null nothing no answer empty blank undefined tbd todo keine kein antwort nichts leer entfällt ohne nada ninguna ninguno rien aucun aucune néant niente nessuna nessuno vuoto geen niets leeg nenhum nenhuma vazio sem".split())
# How messages begin and end.
SALUTATION = (
    r"(?:hello|hi|hey|dear|good (?:morning|afternoon|evening|day)|greetings|to whom it may concern|hallo|guten (?:tag|morgen|abend)|moin|liebe[rs]?|sehr geehrte[rs]?|werte[rs]?|bonjour|bonsoir|ch[eè]re?s?|madame|monsieur|hola|estimad[oa]s?|buen[oa]s (?:días|tardes|noches)"
    r"|buongiorno|buonasera|gentil[ei]|egregi[oa]|ciao|salve|beste|geachte|goede(?:morgen|middag|navond| dag)|dag|ol[áa]|prezad[oa]s?|car[oa]s?|bo[am] (?:dia|tarde|noite))\b"
)
SIGN_OFF = (
    r"(?:(?:kind|best|warm|with (?:kind|best)|many) (?:regards|wishes|thanks)|regards|best wishes|(?:yours )?(?:sincerely|faithfully|truly)|thanks(?: in advance| a lot)?|thank you(?: very much)?|cheers|all the best|(?:mit )?(?:freundlich|best|viel|schön|lieb|herzlich)\w* gr(?:ü|ue)(?:ß|ss)(?:en|e)?|gr(?:u|ü)(?:ß|ss)e?|mfg|vielen dank|danke(?: und gruß)?|besten dank"
    r"|cordialement|bien à vous|(?:meilleures|sincères) salutations|merci(?: d'avance)?|(?:un )?(?:cordial )?saludos?(?: cordiales)?|atentamente|gracias|(?:cordiali|distinti) saluti|grazie|(?:met )?vriendelijke groet(?:en)?|(?:hartelijk )?dank|bedankt|atenciosamente|(?:com os melhores )?cumprimentos|obrigad[oa])"
)
#: Every SIGN_OFF has a word that begins so.
CLOSING = ("regards", "wishes", "thank", "sincerely", "faithfully", "truly", "cheers", "best", "gru", "grü", "mfg", "dank", "cordial", "vous", "salut", "merci", "saludo", "atentamente", "gracias", "grazie", "groet", "bedankt", "atenciosamente", "cumprimentos", "obrigad")
#: Last lines that follow a finished text: a reference to the case.
REFERENCE = r"(?:case|ticket|reference|ref|incident|request|id|fall|vorgang|ticketnummer|kennung|nummer|caso|dossier|cas|zaak|pratica|processo)\W{0,4}(?:no\W{0,2}|nr\W{0,2})?[\p{Lu}\d-]*\d[\p{L}\d-]*"
# Kinds of words, by which refusals and courtesies are told; * stands for any ending.
KINDS = {
    "N": "without außerstande ohne sin sans senza zonder sem nor neither weder noch ni not no never cannot can't cant couldn't won't wouldn't don't doesn't isn't aren't mustn't mayn't nothing none unable impossible nicht kein keine keinen keinem keiner keinerlei nie niemals nichts unmöglich nunca nada ningún ninguna imposible ne pas jamais aucun aucune rien impossible n'est n'ai non nessun nessuna nessuno niente mai impossibile niet geen nooit niets onmogelijk não nenhum nenhuma impossível",
    "A": "außerstande capable position prevent* forbid* forbidden prohibit* untersag* verboten verbiet* hindern vermag darfst authoriz* autoris* autoriz* prohib* interdi* vietat* verboden proib* can cannot can't cant could couldn't able unable may might allow* permit* possible willing position authorised authorized want wish capable empowered kann können könnten darf dürfen möglich lage erlaub* befugt gestatt* zulässig imstande lassen lässt möchte möchten will wollen puedo podemos puede pueden posible autorizad* quiero peux pouvons peut possible autoris* permet* posso possiamo può possibile permess* autorizzat* grado kan kunnen mag mogen mogelijk toegestaan bevoegd staat podem pode possível permitid*",
    "R": "unanswered unbeantwortet declin* refus* reject* abstain* refrain* ablehn* abzulehnen verweiger* lehne lehnen weiger* enthalt* absehen rechaz* deneg* niego negar abst* décline* rifiut* weiger* afwijz* recus*",
    "H": "reden rede redet tell telling cover covers reveal* respuesta ayuda réponse aide dire trait* risposta aiuto antwoorden hulp uitleg resposta ajuda falar hablar parler parlare praten tratar tratamos decir decirle dizer engage participate entertain weitersag* preisgeb* beraten beratung behandeln eingegangen geäußert help* assist* answer* respond* response* reply replies comment* discuss* support* provid* offer* give given giving share sharing disclos* advis* advice handle* deal dealt process* fulfil* fulfill* comply accommodat* address* talk* speak* say saying guidance information statement opinion helf* geholfen hilfe beantwort* antwort* auskunft auskünfte unterstütz* äußer* kommentar* sagen mitteil* weitergeb* weiterzugeben bereitstell* bereitzustellen verfügung anbiet* anzubieten angeboten bearbeit* stellung sage sagt nachkomm* nachzukomm* eingehen einzugehen gehe gehen weiterhelf* weiterzuhelf* behilflich besprech* sprechen diskut* erfüll* leisten geben informier* aussage ayud* respond* contest* coment* asist* ofrec* proporcion* inform* apoy* atender aid* répond* fourni* donner renseign* traiter discuter aiut* rispond* forni* offr* dare discut* beantwoord* antwoord* reager* bijstaan bied* verstrek* ondersteun* bespreken behandel* geven ajud* oferec* fornec* prestar",
    "T": "themen type types tipo tipi soort genre art tema temas argomenti onderwerpen sujets assuntos inhalt* request this that it these such request* question* message* matter* inquir* enquir* query queries topic* subject* issue* case kind something anything dies* das es anfrage* frage* nachricht* anliegen sache* thema fall bitte bitten art hierbei hierauf hiervon hierüber dabei hierzu dazu damit darauf darüber daran etwas solche* derartige* ihnen you sie dir solicitud* pregunta* consulta* mensaje asunto tema eso esto demande* sujet cela ça richiesta richieste domanda domande messaggio argomento questo ciò vraag vragen verzoek bericht onderwerp dit dat pedido* pergunta* mensagem assunto isto isso",
    "I": "i i'm i'd i'll i've we we're we'd me us my our ich wir mir mich uns mein* unser* yo nosotros puedo podemos siento lamento lamentamos nuestr* je j'ai nous peux pouvons mes io noi posso possiamo mi ik wij we mij ons eu nós meu minha",
    "S": "sorry afraid unfortunately regret* apolog* leider bedauer* leid entschuldig* siento lament* desgraciadamente désolé* regrett* malheureusement dispiace spiac* purtroppo spijt* helaas desculp* infelizmente",
    "L": "purview remits limits grenzen befugnis* competencia* compétence* competenz* bevoegdheid* guideline* polic* rule* instruction* outside beyond scope remit richtlinie* vorgabe* regel* anweisung* außerhalb jenseits rahmen zuständig* normas política* directrices fuera règle* consigne* dehors regole direttive fuori richtlijn* regels buiten regras fora",
    "W": "assistant* automated automatic ai bot model language assistent* automat* sprachmodell ki modelo lenguaje modèle langage modello linguistico taalmodel linguagem",
    "C": "thank* thanks appreciate dank* vielen verständnis gracias merci grazie bedankt begrip obrigad* understanding patience geduld comprensión compréhension comprensione compreensão inconvenien* unannehmlich*",
    "D": "nice schönen schöne angenehmen alles buen bonne buona fijne bom boa luck glück hope wish hoffe hoffen wünsche* espero espère espérons spero hoop",
    "E": "elsewhere else other another somebody someone anderswo andere* sonst weitere* jemand otra otro autre ailleurs altro altra altrove elders ander* outra outro kollege* colleague* department abteilung stelle office",
    "P": "contact turn ask visit try consult call wenden kontaktieren fragen versuchen suchen póngase contacte contactez contatti contattare neem contacteer need brauchen gibt find finden",
    "X": "if unless until when once wenn sobald solange si cuando quand lorsque quando zodra",
}
# What a declining sentence says, as kinds of words in order.
DECLINING = ("NAH", "ANH", "AHN", "NH", "HN", "HAN", "LAH", "LHA", "LNA", "R", "HNA", "HL", "LH", "LIH")
#: The same without an act of answering, if all words of the sentence have a kind.
BARE = ("TNA", "NAT", "TAN", "TL")
# Function words beside the common ones of a language.
FUNCTION = frozenset(
    "über gehört gehören sehe sehen estoy estamos soy suis sommes sono siamo ben zijn sou estou somos falls fall there here therefore thus hence must should would shall these those some such very just rather been being into upon since while because though only even well too muss müssen musst sollte sollten würde würden dessen deren daher deshalb darum hier dort liegt liegen diese dieser dieses diesem diesen mein dein sein ihr ihm ihnen uns euch mehr sehr gern gerne lieber eher doch schon mal jetzt nun so soweit insofern bleibt bleiben"
    " aquí allí entonces debe debemos debería esta este estas estos muy así ahora ici alors donc dois devons devrait cette votre vos très ainsi maintenant suite qui quoi deve dobbiamo dovrebbe questa questi queste molto così adesso qui lì quindi vostra vostro sua suo hier daar dus moet moeten zou zouden deze onze jouw heel nu hierbij hiermee hierop aqui ali então deve devemos esta este estes muito assim agora vossa vosso".split()
)
# Content words among the common ones of a language.
_CONTENT = frozenset("problem error computer login password invoice licence printer connection file open work fehler rechner anmeldung kennwort rechnung lizenz drucker verbindung datei öffnen funktioniert".split())

_NAMES = regex.compile(r"<\s*/?\s*[\p{L}_]{1,20}\s*/?>")
_WORD = regex.compile(r"[\p{L}\p{N}']+")
_LETTERS = re.compile(r"[^\W_]+")
_BEGINS = regex.compile(rf"^\W*{SALUTATION}[^.!?\n]{{0,60}}?(?:[,!:.\n]|$)\s*", regex.IGNORECASE)
_ENDS = regex.compile(rf"(?:^|(?<=[\s.!?,;\n>])){SIGN_OFF}\b[\s,.!-]*(?:[\p{{L}}.'_<>-]+[\s,.]*){{0,4}}$", regex.IGNORECASE)
_REFERRED = regex.compile(rf"(?:^|[\s.!?\n(\[])[(\[]?{REFERENCE}[)\]]?\s*$", regex.IGNORECASE)
_FINISHED = regex.compile(r"(?<!\.\.)[.!?。][\"'”“»«›’)\]*_]*\s*$")
_NUMBERED = regex.compile(r"(?:^|\n|[.!?:]\s+)\s*(?:\d{1,2}[.)]|[-*•])\s*$")
_CUT = regex.compile(r"(?<=[.!?…])[\"'”“»)]*\s+|\s*\n\s*")


def lcs(a: list[str], b: list[str] | str) -> int:
    """Length of the longest common subsequence, by bit-parallel steps."""
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & masks.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class _Kinds(dict):
    """Words to the letters of their kinds; O: of none, empty: a function word. Bounded by KEPT."""

    def __init__(self):
        super().__init__()
        self._exact: dict[str, str] = {}
        self._stems: dict[str, str] = {}
        for kind, words in KINDS.items():
            for w in dict.fromkeys(words.split()):
                to = self._stems if w.endswith("*") else self._exact
                to[w.rstrip("*")] = to.get(w.rstrip("*"), "") + kind
        self._function = FUNCTION.union(*(text.split() for text in COMMON.values())) - _CONTENT

    def __missing__(self, word: str) -> str:
        if len(self) >= KEPT:
            self.clear()
        out = self._exact.get(word, "") or next((self._stems[word[:n]] for n in range(len(word), 2, -1) if word[:n] in self._stems), "")
        if not out and len(word) > 3 and word not in self._function:
            out = "O"
        self[word] = out
        return out


class _Parts(dict):
    """Blank-separated strings to the words in them, each after a blank. Bounded by KEPT."""

    def __missing__(self, token: str) -> str:
        if len(self) >= KEPT:
            self.clear()
        out = self[token] = "".join([" " + w for w in _LETTERS.findall(token.lower())])
        return out


class _Closing(dict):
    """Blank-separated strings to whether a word in them may end a message. Bounded by KEPT."""

    def __missing__(self, token: str) -> bool:
        if len(self) >= KEPT:
            self.clear()
        out = self[token] = any(w.startswith(CLOSING) for w in _LETTERS.findall(token.lower()))
        return out


_kinds, _parts, _closing = _Kinds(), _Parts(), _Closing()


def content(text: str) -> tuple[str, bool]:
    """A response without markup, salutation and sign-off, and whether it had a sign-off or ends with a reference."""
    flat = plain(text).strip()
    body = _BEGINS.sub("", flat, count=1)
    last = body[-1:]
    closed = (last.isalnum() or last in ")]") and bool(_REFERRED.search(body[-80:]))
    tail = body[-160:]
    m = _ENDS.search(tail) if any([_closing[t] for t in tail.split()]) else None
    if m:
        body, closed = body[: len(body) - len(tail) + m.start()], True
    return body.strip(), closed


def is_empty(body: str) -> bool:
    text = _NAMES.sub(" ", body) if "<" in body else body
    return all(m.group().lower() in NOTHING for m in _LETTERS.finditer(text))


def declines(words: list[str]) -> bool:
    """Whether a sentence only declines to answer: it aligns to a template, names no condition and hardly anything else."""
    kinds = "".join([_kinds[w] for w in words])
    if "X" in kinds or words[0] == "falls" or not ("R" in kinds or "N" in kinds or "L" in kinds or "A" in kinds):
        return False
    other = kinds.count("O")
    most = max(1, UNRELATED * len(words)) if "I" in kinds else 0
    return any(lcs(list(t), kinds) == len(t) for t in (DECLINING if other <= most else ()) + (BARE if not other else ()))


def is_courtesy(words: list[str]) -> bool:
    """Whether a sentence thanks, regrets, wishes or points elsewhere."""
    kinds = "".join([_kinds[w] for w in words])
    if kinds.count("O") > max(1, UNRELATED * len(words)):
        return False
    return "C" in kinds or "D" in kinds or ("E" in kinds and ("P" in kinds or "H" in kinds or "A" in kinds)) or ("S" in kinds and "O" not in kinds)


def is_refusal(body: str) -> bool:
    """Whether every sentence declines or is a courtesy, one of them declining."""
    found = False
    for p in _CUT.split(body.lower().replace("’", "'")):
        words = _WORD.findall(_NAMES.sub(" ", p) if "<" in p else p)
        if not words:
            continue
        if declines(words):
            found = True
        elif not is_courtesy(words):
            return False
    return found


def is_truncated(body: str, closed: bool) -> bool:
    """Whether body breaks off: no end of a sentence, no sign-off and no reference at its end, or the number of an item without it."""
    if closed:
        return False
    end = body[-40:]
    if _NUMBERED.search(end):
        return True
    return not _FINISHED.search(end) and len(_WORD.findall(body)) >= 4


def is_copy(response: str, prompt: str) -> bool:
    """Whether the response's words are the prompt's, by shingles and by common order; shorter ones than a shingle, if they are a line or sentence of it."""
    own = "".join([_parts[t] for t in response.split()])
    mine = own.split()
    n = len(mine)
    if not n:
        return False
    if n < SHINGLE:
        return any("".join([_parts[t] for t in p.split()]) == own for p in _CUT.split(prompt))
    theirs = "".join([_parts[t] for t in prompt.split()])
    asked = theirs.split()
    known = set(asked)
    common = sum(map(known.__contains__, mine))
    if 2 * common < n - SHINGLE + 1 - (n - len(set(mine))) * SHINGLE:  # fewer shingles than this can't be, and each shared one begins at a common word
        return False
    shingles = {" " + " ".join(mine[i : i + SHINGLE]) + " " for i in range(n - SHINGLE + 1)}
    if 2 * common < len(shingles):  # each shared shingle begins at a common word
        return False
    theirs += " "
    contained = sum([x in theirs for x in shingles]) / len(shingles)
    if contained >= CONTAINED:
        return n >= PARTIAL or contained == 1.0
    return n >= PARTIAL and common >= COMMON_ORDER * n and lcs(mine, asked) >= COMMON_ORDER * n


def defect(subject: str | None, body: str | None, answer: str | None) -> tuple[str | None, str]:
    """The defect type of a pair, empty, copy, refusal or truncated, the first of them that holds; and the content of the answer."""
    if answer is None:
        return "empty", ""
    own, closed = content(answer)
    if is_empty(own):
        return "empty", own
    if is_copy(own, plain(f"{subject or ''}\n{body or ''}")):
        return "copy", own
    if is_refusal(own):
        return "refusal", own
    return ("truncated" if is_truncated(own, closed) else None), own


def foreign(judge: Judge, prompts: list[str], responses: list[str]) -> list[bool]:
    """Whether each response is in a language in which no stretch of its prompt is, both being clear."""
    _, asked, sure = judge.totals(prompts)
    _, said, win = judge.totals(responses)
    out = (asked != said) & (sure >= FOREIGN_BYTES) & (win >= FOREIGN_BYTES)
    at = out.nonzero()[0].tolist()
    for i, langs in zip(at, judge.stretches([prompts[i] for i in at])[0]):
        out[i] = int(said[i]) not in langs
    return out.tolist()


def broken_pairs(tickets: DataFrame, audit: DataFrame, id_col: str = "source_row_id", subject_col: str = "subject", body_col: str = "body", answer_col: str = "answer", label_col: str = "language") -> DataFrame:
    """(id_col, defect_type): each ticket without a usable answer, once.

    A null answer is empty whatever the prompt; a null or empty prompt has no
    copy and no other language. Rows that come twice count once; of an id with
    different rows the first defect in the alphabet is given; a null id is
    left out; an empty table gives an empty one. Whole texts are compared.
    """
    texts = tickets.sparkSession.sparkContext.broadcast(dictionaries(tickets, audit, id_col, [body_col, answer_col], label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*texts.value)
        for b in batches:
            bodies = b.column("body").to_pylist()
            judged = [defect(*row) for row in zip(b.column("subject").to_pylist(), bodies, b.column("answer").to_pylist())]
            kinds = [k for k, _ in judged]
            whole = [i for i, k in enumerate(kinds) if k is None]
            for i, other in zip(whole, foreign(judge, [bodies[i] or "" for i in whole], [judged[i][1] for i in whole])):
                if other:
                    kinds[i] = "other_language"
            at = [i for i, k in enumerate(kinds) if k]
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), pa.array([kinds[i] for i in at], pa.string())], names=["id", "defect_type"])

    named = tickets.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), *[F.col(c).cast("string").alias(n) for c, n in ((subject_col, "subject"), (body_col, "body"), (answer_col, "answer"))])
    found = written(named.mapInArrow(run, "id bigint, defect_type string"), "pairs")
    return found.groupBy(F.col("id").alias(id_col)).agg(F.min("defect_type").alias("defect_type"))
