"""Template residue, filler and error-page text, by positive-unlabelled naive Bayes.

Fields are cut into passages; fields that fixed patterns recognise beyond
doubt are the trusted positives, all others are unlabelled. Naive Bayes over
hashed words is fitted by expectation-maximization over every passage: the
trusted ones keep probability 1, each unlabelled one gets what the model
gives it. A field consists of residue if passages judged so hold nearly all
its words. Placeholders have a second model of the same kind over the words
around each, since a message may also report one: several in a field, or one that says to
fill it in, are trusted there, unless a word nearby tells of a report.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words are hashed to this many features per model.
FEATURES = 1 << 18
ROUNDS = 4
ALPHA = 0.1
#: Words drawn from the whole corpus that are added to those of either class, in words of the positive class: a word that the class lacks counts log(SMOOTH) at least.
SMOOTH = 0.05
#: The same for the words around a placeholder, which tell less.
LIKE_ANY = 2.0
#: Share of a field's words that residue passages hold, at least.
CONSISTS = 0.65
#: Share of a field's words in passages with a seed that makes it trusted; for the passages of fields of up to SHORT words, too.
SEEDED = 1 / 3
SHORT = 30
#: Strings of which a worker keeps the words; when there are more, it begins anew.
KEPT = 300_000
PASSAGE, MARK = 0, 1

# What the corpus' own anonymization writes, in any spelling of one edit at most.
PROPER = ("name", "tel_num", "email_address")
# Unfilled placeholders of common template languages.
MARKS = {
    "mustache": r"\{\{[^{}]{1,60}\}\}", "block": r"\{%[^{}]{1,60}%\}", "dollar": r"\$\{[^{}]{1,60}\}", "hash": r"\#\{[^{}]{1,60}\}", "index": r"\{\d{1,2}\}",
    "square": r"\[\[[^\[\]]{1,60}\]\]", "angle": r"<<[^<>]{1,60}>>?", "at": r"@@[\p{L}_.\d]{1,40}@@", "under": r"__\p{L}[\p{L}_.\d]{0,40}__(?!\w)", "percent": r"%\p{L}[\p{L}_.]{1,40}%", "printf": r"(?<![\w%])%[sd](?!\w)|%\(\w+\)[sd]",
    "fill": r"(?:\[|<|&lt;)\s*(?:insert|enter|your|type|add|please|ihre?|hier|bitte|inserte|introduzca|su|votre|saisir|insérer|inserisci|inserire|insira|inserir|vul|voeg|uw)\b[^\[\]<>&]{1,60}(?:\]|>|&gt;)|(?:\[|<|&lt;)[^\[\]<>&]{1,60}\b(?:einfügen|eintragen|eingeben|ergänzen|here|aquí|ici|qui|aqui|invullen)\s*(?:\]|>|&gt;)",
    "entity": r"&lt;\p{L}[\p{L}_. ]{1,40}&gt;", "bracket": r"\[\p{Ll}[\p{Ll}_. ]{2,40}\]",
}
_MARK = regex.compile("|".join(f"(?P<{k}>{v})" for k, v in MARKS.items()), regex.IGNORECASE)
_BRACKET = regex.compile(MARKS["bracket"])
# Words of a passage that is trusted to be residue; the first of each line is the rarest.
SEEDS = """
ipsum lorem
amet dolor
javascript enable
javascript activate
javascript disabled
javascript required
javascript aktivieren
javascript deaktiviert
javascript activer
javascript activar
cookies enable
404 not found
404 http
500 server error
502 http
503 http
internal server error
interner serverfehler
502 gateway
504 gateway
500 serverfehler
503 dienst
503 service unavailable
403 forbidden
401 unauthorized
found page not
gefunden seite nicht
denied access
verweigert zugriff
dummy text
dummy subject
placeholder text
placeholder subject
sample text
sample subject
beispieltext
beispielbetreff
platzhaltertext
platzhalterbetreff
blindtext
mustertext
enter your text
enter your message
enter your subject
type your message
describe your problem
eingeben betreff
eingeben nachricht
eingeben text
429 requests
requests too many
anfragen zu viele
fatal error
fehler schwerer
exception uncaught
traceback
scripting browser
skriptunterstützung
skripte erlaubt
skripte aktivieren
skripte einschalten
scripts enable
scripts allow
scripts allowed
placeholder copy
datenbank verbindung keine
database connection error
database connection failed
erreichbar website nicht
browser geprüft ihr
schiefgelaufen etwas
schiefgegangen etwas
variable template
variable vorlage
reached site can
respond took too long
expired session
abgelaufen sitzung
unavailable temporarily
browser checking your
wrong something went
denied permission
rendered template
"""
# Runs of letters on a keyboard that no word has.
RUNS = "asdf sdfg dfgh fghj ghjk hjkl jklö jklk qwer yxcv xcvb cvbn zxcv poiu oiuz oiuy lkjh kjhg jhgf hgfd gfds fdsa"
# Somebody speaks for themselves, so the text is not trusted to be residue.
OWN = "i my our us ours ich mein meine meinen meinem meiner uns unser unsere unseren unserem unserer wir mir nous notre nos nuestro nuestra nuestros nuestras nostro nostra nosso nossa ons onze hello dear hallo sehr regards grüße"
# Words with which a placeholder is reported and not left over; pseudo-counts for the other class of that model.
REPORTED = "literal literally wörtlich text prints shows displays zeigt steht druckt statt instead place placeholder platzhalter template vorlage label etikett greet begrüßen appears erscheint mend berichtigen".split()
_REPORTED = frozenset(REPORTED)
#: One of these is enough for a report; of the others it takes two.
_LITERALLY = frozenset("literal literally wörtlich placeholder platzhalter".split())

_ZERO = regex.compile("[​‌‍⁠﻿­]")
_TAG = regex.compile(r"</?(?:html|body|h\d|hr|br|p|div|span|noscript|b|i|u|a|ul|ol|li|table|tr|td|head|title|script|pre|code|font|strong|em|center|img)\b[^<>]{0,200}>", regex.IGNORECASE)
_LITERAL = regex.compile(r"\\[nrt]")
_WORD = re.compile(r"[^\W\d_]+|\d+")
_SEED_WORDS = frozenset(SEEDS.split())
_RUNS = re.compile("|".join(RUNS.split()))


def _id(word: str) -> int:
    """The feature of a word; numbers are one, but for those in SEEDS, and noise from the keyboard is one."""
    if word.isdigit() and word not in _SEED_WORDS:
        word = "0"
    elif _RUNS.search(word):
        word = "noise on the keyboard"
    return zlib.crc32(word.encode()) & (FEATURES - 1)


class _Ids(dict):
    """Blank-separated lower-case strings to the features of their words. Bounded by KEPT."""

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= KEPT:
            self.clear()
        out = self[token] = tuple(_id(w) for w in _WORD.findall(token))
        return out


_ids = _Ids()
_NOISE = _id("asdf")
_SEEDED = {k: [frozenset(map(_id, line.split())) for line in SEEDS.strip().split("\n") if _id(line.split()[0]) == k] for k in {_id(line.split()[0]) for line in SEEDS.strip().split("\n")}}
_SEEDED[_NOISE] = [frozenset([_NOISE])]
_KEYS = frozenset(_SEEDED)
#: Numbers in SEEDS are like all others to the model.
_NUMBER = _id("0")
_NUMBERS = frozenset(_id(w) for w in _SEED_WORDS if w.isdigit())
_OWN = frozenset(map(_id, OWN.split()))
#: A passage of nothing but a placeholder.
_PLACE = [_id("phmark")]


def _near_proper(inner: str) -> bool:
    """Whether inner is one of PROPER, or spelled with one edit or swap."""
    inner = inner.strip().lower()
    for p in PROPER:
        if inner == p or (abs(len(inner) - len(p)) <= 1 and sorted(inner) == sorted(p)):
            return True
        if abs(len(inner) - len(p)) <= 1 and inner[:1] == p[:1]:
            k = next((i for i, (x, y) in enumerate(zip(inner, p)) if x != y), min(len(inner), len(p)))
            if inner[k:] == p[k + 1 :] or inner[k + 1 :] == p[k:] or inner[k + 1 :] == p[k + 1 :]:
                return True
    return False


_QUICK = ("{", "[", "<<", "@@", "__", "%", "&lt;")
_FILLED = regex.compile(r"<[^<>]+ [^<>]+>")


def placeholders(text: str) -> list[tuple[str, int, int]]:
    """(kind, begin, end) of each possible placeholder."""
    if not any(c in text for c in _QUICK) and not ("<" in text and _FILLED.search(text)):
        return []
    out = []
    for m in _MARK.finditer(text):
        kind = m.lastgroup or ""
        inner = m.group().replace("&lt;", "").replace("&gt;", "").strip("<>[]")
        if kind == "entity" and (_near_proper(inner) or _TAG.fullmatch(f"<{inner}>")):
            continue
        if kind == "bracket" and not _BRACKET.fullmatch(m.group()):
            continue
        out.append((kind, m.start(), m.end()))
    return out


def plain(text: str, found: list[tuple[str, int, int]] | None = None) -> str:
    """Text without markup, escapes and invisible characters; placeholders become a word."""
    for _, a, b in reversed(placeholders(text) if found is None else found):
        text = f"{text[:a]} phmark {text[b:]}"
    if "\\" in text:
        text = _LITERAL.sub("\n", text)
    if "<" in text:
        text = _TAG.sub("\n", text)
    if "&" in text:
        text = html.unescape(text)
    return text if text.isascii() else _ZERO.sub("", text)


def passages(flat: str) -> list[list[int]]:
    """Features of each passage that has words, of a lower-case text."""
    out = []
    for p in flat.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n"):
        w = [x for t in p.split() for x in _ids[t]]
        if w:
            out.append(w)
    return out


def seeded(passage: list[int]) -> bool:
    """Whether a passage has all words of a line of SEEDS, or noise from the keyboard."""
    keys = _KEYS.intersection(passage)
    if not keys:
        return False
    words = frozenset(passage)
    return any(s <= words for k in keys for s in _SEEDED[k])


def trusted(lists: list[list[int]]) -> bool:
    """Whether a field of these passages is trusted to be residue."""
    sure = [len(w) for w in lists if seeded(w)]
    if not sure or any(not _OWN.isdisjoint(w) for w in lists):
        return False
    whole = sum(map(len, lists))
    return sum(sure) >= SEEDED * whole or (len(sure) >= SEEDED * len(lists) and whole <= SHORT)


def mark_contexts(text: str, field: str, found: list[tuple[str, int, int]]) -> list[tuple[list[int], int]]:
    """Features around each possible placeholder, and 1 if it is trusted to be left over, -1 if to be reported, else 0."""
    out = []
    for kind, a, b in found:
        before = _WORD.findall(plain(text[max(0, a - 80) : a]).lower())[-6:]
        after = _WORD.findall(plain(text[b : b + 80]).lower())[:6]
        near = _REPORTED.intersection(before + after)
        reported = len(near) > 1 or not _LITERALLY.isdisjoint(near)
        sure = 1 if kind == "fill" or (len(found) > 1 and not reported) else -1 if reported else 0
        out.append(([_id("kind " + kind), _id("field " + field), *(_id(w) for w in before + after)], sure))
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {"id": [], "field": [], "model": [], "sure": [], "f": [], "n": []}

        def add(key, field, model, sure, lists):
            for k, v in zip(out, (key, field, model, sure, [x for w in lists for x in w], [len(w) for w in lists])):
                out[k].append(v)

        for name in ("subject", "body"):
            for key, text in zip(b.column("id").to_pylist(), b.column(name).to_pylist()):
                if not text:
                    continue
                found = placeholders(text)
                lists = passages(plain(text, found).lower())
                if lists:
                    sure = int(trusted(lists) or (bool(found) and all(w == _PLACE for w in lists)))
                    add(key, name, PASSAGE, sure, [w if _NUMBERS.isdisjoint(w) else [_NUMBER if x in _NUMBERS else x for x in w] for w in lists])
                for features, sure in mark_contexts(text, name, found):
                    add(key, name, MARK, sure, [features])
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["id"], pa.int64()), pa.array(out["field"], pa.string()), pa.array(out["model"], pa.int32()), pa.array(out["sure"], pa.int32()), pa.array(out["f"], pa.list_(pa.int32())), pa.array(out["n"], pa.list_(pa.int32()))], names=list(out),
        )


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features in the joint space, first of each passage, row of each passage, words of each)."""
    n = b.column("n").flatten().to_numpy()
    row = np.repeat(np.arange(b.num_rows), np.asarray(b.column("n").value_lengths(), np.int64))
    model = b.column("model").to_numpy()[row].astype(np.int64)
    f = b.column("f").flatten().to_numpy().astype(np.int64) + np.repeat(model, n) * FEATURES
    return f, np.cumsum(n) - n, row, n


def _score(b: pa.RecordBatch, weights: np.ndarray, bias: tuple[float, float]):
    f, start, row, n = _flat(b)
    odds = np.add.reduceat(weights[f], start) + np.array(bias)[b.column("model").to_numpy()[row]]
    chance = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return f, row, n, chance


def fit(features: DataFrame, rounds: int = ROUNDS) -> tuple[bytes, tuple[float, float]]:
    """Log-odds weight of each feature, and the prior log-odds, of the two models.

    Each round is one map over all passages; a task returns one sum per
    feature at most, so what reaches the driver is bounded by FEATURES.
    """
    spark = features.sparkSession
    known: list = [None, (0.0, 0.0)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * FEATURES + 4)
        for b in batches:
            if not b.num_rows:
                continue
            if known[0] is None:
                f, start, row, n = _flat(b)
                chance = 0.5 * b.column("model").to_numpy()[row]  # of unlabelled marks, many are left over
            else:
                f, row, n, chance = _score(b, np.frombuffer(known[0].value), known[1])
            sure = b.column("sure").to_numpy()[row]
            chance = np.where(sure > 0, 1.0, np.where(sure < 0, 0.0, chance))
            total[: 2 * FEATURES] += np.bincount(f, np.repeat(chance, n), 2 * FEATURES)
            model = b.column("model").to_numpy()[row]
            total[2 * FEATURES :] += [chance[model == 0].sum(), (model == 0).sum(), chance[model == 1].sum(), (model == 1).sum()]
        at = np.flatnonzero(total > 1e-6)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["k", "v"])

    def gathered(df: DataFrame) -> np.ndarray:
        out = np.zeros(2 * FEATURES + 4)
        t = df.groupBy("k").agg(F.sum("v").alias("v")).toArrow()
        out[t["k"].to_numpy()] = t["v"].to_numpy()
        return out

    #: All words, trusted or not, once.
    everything = gathered(features.select("model", F.explode("f").alias("k")).groupBy((F.col("k") + F.col("model") * FEATURES).alias("k")).agg(F.count("*").cast("double").alias("v")))
    for w in REPORTED:
        everything[FEATURES + _id(w)] += 20
    weights = np.zeros(2 * FEATURES)
    bias = (0.0, 0.0)
    for _ in range(rounds):
        got = gathered(features.mapInArrow(sums, "k int, v double"))
        odds = []
        for m in (PASSAGE, MARK):
            part = slice(m * FEATURES, (m + 1) * FEATURES)
            pos = got[part]
            neg = np.maximum(everything[part] - pos, 0)
            base = (everything[part] + ALPHA) / (everything[part].sum() + ALPHA * FEATURES)
            few = (SMOOTH if m == PASSAGE else LIKE_ANY) * pos.sum() + 1
            weights[part] = np.log((pos + few * base) / (pos.sum() + few)) - np.log((neg + few * base) / (neg.sum() + few))
            p, n = got[2 * FEATURES + 2 * m], got[2 * FEATURES + 2 * m + 1]
            odds.append(math.log((p + 1) / max(1.0, n - p + 1)))
        bias = (odds[0], odds[1])
        known[:] = [spark.sparkContext.broadcast(weights.tobytes()), bias]
    return weights.tobytes(), bias


def residue(df: DataFrame, id_col: str = "source_row_id", subject_col: str = "subject", body_col: str = "body") -> DataFrame:
    """(id_col, found_in): the fields that hold an unfilled placeholder or consist of filler, noise, prompts, error pages or script notices.

    Null, empty and wordless fields are never found; rows that come twice
    count once; an id with different rows is found if any of them is; a null
    id is left out; an empty table gives an empty one. Whole texts are read;
    other columns are ignored.
    """
    named = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(subject_col).cast("string").alias("subject"), F.col(body_col).cast("string").alias("body"))
    features = named.mapInArrow(_features, "id bigint, field string, model int, sure int, f array<int>, n array<int>").persist(StorageLevel.MEMORY_AND_DISK)
    weights, bias = fit(features)
    known = df.sparkSession.sparkContext.broadcast(weights)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            _, row, n, chance = _score(b, np.frombuffer(known.value), bias)
            bad = np.bincount(row, np.where(chance > 0.5, n, 0), b.num_rows) / np.maximum(1, np.bincount(row, n, b.num_rows))
            any_mark = np.bincount(row, chance > 0.5, b.num_rows) > 0
            sure = b.column("sure").to_numpy()
            found = ((np.where(b.column("model").to_numpy() == MARK, any_mark, bad >= CONSISTS)) & (sure >= 0)) | (sure > 0)
            at = pa.array(np.flatnonzero(found))
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("field").take(at)], names=["id", "found_in"])

    from ticketloom.session import written

    out = written(features.mapInArrow(judge, "id bigint, found_in string").distinct(), "residue")
    features.unpersist()
    return out.select(F.col("id").alias(id_col), "found_in")


def without_residue(df: DataFrame, found: DataFrame, id_col: str = "source_row_id") -> DataFrame:
    """The rows of df without a found field; rows with a null id stay."""
    return df.join(found.select(id_col).distinct(), id_col, "left_anti")
