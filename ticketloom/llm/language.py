"""Language of documents and of the stretches of mixed ones, by compression.

A dictionary of raw text per language is made of a general text, common words
and a bounded sample of rows whose label or detector names it. Each sentence
is compressed against every dictionary; its cost in a language is the
compressed size. Over the sentences of a text the cheapest sequence of
languages is chosen, where a change of language costs SWITCH bytes; sentences
with narrow margins thereby follow their neighbours, and a text whose margin
stays narrow is decided by review, detector and label. A worker keeps the
costs of the sentences it has seen, so that repeated ones are compressed once.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.prose import PROSE
from ticketloom.session import discard, written

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pt")
#: Rows per language for the dictionaries, and bytes of a dictionary beside the general text, at most.
SAMPLE = 800
DICTIONARY = 16_000
LEVEL = 6
#: Bytes that a change of language costs.
SWITCH = 11.0
#: Bytes by which the best language must win over a text, else other evidence decides; one known word is worth three.
NARROW = 3.5
#: Texts of one language's sample that a capitalised word must be in to be no name.
KNOWN = 20
#: Detector's confidence from which it is believed, with an equal label and without.
SURE = 0.985
LIKELY = 0.9
#: Words and sentences that a worker keeps; when there are more, it begins anew.
WORDS_KEPT = 200_000
SENTENCES_KEPT = 200_000

# Spellings of the seven languages.
SPELLINGS = {
    "de": "de deu ger german deutsch allemand aleman tedesco duits alemao",
    "en": "en eng english englisch anglais ingles inglese engels",
    "es": "es spa spanish spanisch espanol castellano espagnol spagnolo spaans espanhol",
    "fr": "fr fra fre french franzosisch francais frances francese frans",
    "it": "it ita italian italienisch italiano italien italiaans",
    "nl": "nl nld dut dutch niederlandisch nederlands neerlandais holandes olandese",
    "pt": "pt por portuguese portugiesisch portugues portugais portoghese portugees",
}
# Common words of each language, so that rare ones are known without a sample.
COMMON = {
    "de": "der die das und ist nicht ein eine einen dem den des mit auf für von zu wir sie ich es sich auch bei nach aus wenn aber oder wie noch nur kann können wird werden wurde haben hat sind bitte danke vielen guten tag hallo sehr geehrte damen herren freundlichen grüßen seit gestern heute morgen unser unsere ihr ihre problem fehler rechner anmeldung kennwort rechnung lizenz drucker verbindung datei öffnen funktioniert mehr keine wieder bereits",
    "en": "the of and to in is that for it with as was on are be this have from or by not but what all were when we there can an your which their if will do how about please thank you dear hello kind regards sincerely since yesterday today our my problem error computer login password invoice licence printer connection file open does not work any more no again already would has been cannot they who than after before without",
    "es": "el la los las de del y que en un una es no se por con para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos estimados buenos días hola gracias saludos cordiales ayer hoy nuestro nuestra problema error equipo contraseña factura licencia impresora conexión archivo abrir podemos hemos",
    "fr": "le la les de des du et que qui dans un une est ne pas se par avec pour son sur au ce il elle nous vous ils plus mais ou où donc leur bien été être avoir fait tout cette ces sans sous aussi comme depuis hier aujourd'hui bonjour madame monsieur merci cordialement notre nos votre problème erreur ordinateur mot de passe facture licence imprimante connexion fichier ouvrir pouvons avons",
    "it": "il lo la i gli le di del della dei e che in un una è non si per con suo al come più ma anche questo quando molto senza su da ha ho hanno sono stato essere fare tutto ci vi noi voi loro dopo prima ancora già ieri oggi buongiorno gentili grazie cordiali saluti nostro nostra problema errore computer password fattura licenza stampante connessione file aprire abbiamo",
    "nl": "de het een en van in is dat op te voor met zijn niet aan er om ook als maar bij of uit naar door over nog wel dan zo hij zij wij we jullie hun ons onze geen meer kunnen kan wordt worden werd hebben heeft had sinds gisteren vandaag goedemorgen beste geachte dank vriendelijke groeten probleem fout computer wachtwoord factuur licentie printer verbinding bestand openen opnieuw",
    "pt": "o a os as de do da dos das e que em um uma é não se por com para seu sua ao como mais mas foi ele ela isso este esta quando muito sem sobre também até há nos já eu você eles depois antes ainda ontem hoje bom dia olá prezados obrigado cumprimentos nosso nossa problema erro computador senha palavra-passe fatura licença impressora ligação ficheiro arquivo abrir",
}

_ZERO = regex.compile("[​‌‍⁠﻿­]")
_TAG = regex.compile(r"<(?:br|p|div|li|hr|h\d)\b[^<>]{0,80}>|</(?:p|div|li|h\d)>|&nbsp;|\\[nrt]", regex.IGNORECASE)
#: Where a sentence may end; and what may stand around a word.
_CUT = re.compile(r"[.!?][\"')»”]*+\s+|\n|;\s|\s(?:[/|>=*#~–—-]{1,5}|!!+)\s+(?=[A-ZÀ-ÖØ-Þ])")
_AROUND = ".,:;!?()[]{}\"'„“”»«‹›‚‘’*|=>~#"


def label_language(c: Column) -> Column:
    """The two letters of a language label in any spelling; null if it is missing or names none of the seven."""
    plain = F.translate(F.lower(F.trim(c.cast("string"))), "äöüéèêñçãáàíóúô", "aoueeencaaaiouo")
    head = F.regexp_extract(plain, r"^\s*([a-z]+)", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for code, names in SPELLINGS.items() for name in names.split() for x in (name, code)]), head)


class Words(dict):
    """Blank-separated strings to their lower-case word, or to nothing if they are marks, numbers, addresses, file names or names.

    A name is a word with a capital letter that is not in vocabulary; with
    None, none is. Bounded by WORDS_KEPT.
    """

    def __init__(self, vocabulary: frozenset[str] | set[str] | None):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> str:
        if len(self) >= WORDS_KEPT:
            self.clear()
        w = token.strip(_AROUND)
        known = w.replace("'", "").replace("-", "").isalpha() and (self.vocabulary is None or w[0].islower() or w.lower() in self.vocabulary)
        out = self[token] = w.lower() if known else ""
        return out


_every_word = Words(None)


def sentences(text: str, words: Words = _every_word) -> list[str]:
    """Sentences and lines of a text as lower-case words, without what words leaves out; in a line of capitals all words stay."""
    out = []
    for part in _CUT.split(_unmarked(text)):
        use = _every_word if part.isupper() else words
        line = " ".join([w for w in [use[t] for t in part.split()] if w])
        if len(line) > 3:
            out.append(line)
    return out


def _unmarked(text: str) -> str:
    if not text.isascii():
        text = _ZERO.sub("", text)
    if "\\" in text or "<" in text or "&" in text:
        text = _TAG.sub("\n", text)
    return text


class Judge:
    """Compressors against the dictionaries; one per task."""

    def __init__(self, texts: dict[str, bytes], vocabulary: set[str] | None = None):
        self._use, self._words = [], Words(vocabulary)
        for code in LANGUAGES:
            d = zstandard.ZstdCompressionDict(texts[code], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self._use.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        self._at: dict[str, int] = {}
        self._known = array("i")

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Compressed size by sentence and language, and the sentences of each text."""
        if len(self._at) > SENTENCES_KEPT:
            self._at, self._known = {}, array("i")
        at, counts = [], []
        for text in texts:
            lines = sentences(text, self._words)
            counts.append(len(lines))
            for line in lines:
                k = self._at.get(line)
                if k is None:
                    k = self._at[line] = len(self._at)
                    data = line.encode()
                    self._known.extend([len(f(data)) for f in self._use])
                at.append(k)
        known = np.frombuffer(self._known, np.int32) if at else np.zeros(0, np.int32)
        return known.reshape(-1, len(LANGUAGES))[np.array(at, np.int64)].astype(float), np.array(counts, np.int64)

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether a text has words, its language, bytes by which that wins) of each text as a whole."""
        table, counts = self.costs(texts)
        has = counts > 0
        lang, win = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        if has.any():
            total = np.add.reduceat(table, (np.cumsum(counts) - counts)[has])
            low = np.partition(total, 1, axis=1)
            lang[has], win[has] = total.argmin(axis=1), low[:, 1] - low[:, 0]
        return has, lang, win

    def stretches(self, texts: list[str]) -> tuple[list[list[int]], list[list[float]], list[list[float]]]:
        """Per text: (languages in order, bytes by which each stretch wins, bytes by which each language loses over the whole)."""
        table, counts = self.costs(texts)
        langs: list[list[int]] = [[] for _ in texts]
        wins: list[list[float]] = [[] for _ in texts]
        losses: list[list[float]] = [[] for _ in texts]
        has = np.flatnonzero(counts)
        if not len(has):
            return langs, wins, losses
        start = np.cumsum(counts) - counts
        total = np.add.reduceat(table, start[has])
        low = np.partition(total, 1, axis=1)
        #: No sequence with a change can be cheaper.
        one = np.add.reduceat(table.min(axis=1), start[has]) + SWITCH > low[:, 0]
        lost = (total - low[:, :1]).tolist()
        for i, k, w, single, x in zip(has.tolist(), total.argmin(axis=1).tolist(), (low[:, 1] - low[:, 0]).tolist(), one.tolist(), lost):
            losses[i] = x
            if single:
                langs[i], wins[i] = [k], [w]
            else:
                langs[i], wins[i] = _sequence(table[start[i] : start[i] + counts[i]])
        return langs, wins, losses


def _sequence(table: np.ndarray) -> tuple[list[int], list[float]]:
    """The cheapest sequence of languages over the sentences of one text: its stretches, and what each wins by."""
    cost, back = table[0].copy(), []
    for row in table[1:]:
        k = int(cost.argmin())
        back.append(np.where(cost[k] + SWITCH < cost, k, np.arange(len(LANGUAGES))))
        cost = np.minimum(cost, cost[k] + SWITCH) + row
    path = [int(cost.argmin())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    path.reverse()
    langs, wins, begin = [], [], 0
    for i in range(1, len(path) + 1):
        if i == len(path) or path[i] != path[begin]:
            part = table[begin:i].sum(axis=0)
            langs.append(path[begin])
            wins.append(float(np.delete(part, path[begin]).min() - part[path[begin]]))
            begin = i
    return langs, wins


_common = {code: frozenset(COMMON[code].split()) | {w for line in sentences(PROSE[code]) for w in line.split()} for code in LANGUAGES}


def _likely(line: str) -> str | None:
    """The language with most of a sentence's words among its common ones; None where two have as many."""
    words = line.split()
    seen = sorted(((sum(w in c for w in words), code) for code, c in _common.items()), reverse=True)
    return seen[0][1] if seen[0][0] > seen[1][0] else None


def dictionaries(tickets: DataFrame, audit: DataFrame, id_col: str, text_cols: list[str], label_col: str) -> tuple[dict[str, bytes], set[str]]:
    """A dictionary per language, and the words that are no names: those in COMMON, PROSE or KNOWN texts of a language's sample.

    The sample has SAMPLE rows per language, chosen by a hash of the id: first
    those on whose language label and confident detector agree, then those
    that the detector alone, then those that the label alone gives to it.
    Sentences whose common words speak for another language are left out.
    """
    detected = label_language(F.col("detected_language"))
    heard = audit.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_k")).agg(F.max_by(detected, "language_confidence").alias("_d"), F.max("language_confidence").alias("_c"))
    named = tickets.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_k")).agg(F.min(label_language(F.col(label_col))).alias("_l"))
    agree = (F.col("_l") == F.col("_d")) & (F.col("_c") >= SURE)
    alone = F.col("_d").isNotNull() & (F.col("_c") >= LIKELY)
    rated = named.join(heard, "_k", "left").select("_k", F.when(agree | ~alone, F.col("_l")).otherwise(F.col("_d")).alias("_lang"), F.when(agree, 0).when(alone, 1).otherwise(2).alias("_rank"))
    rated = written(rated.where("_lang is not null"), "rated")
    counts = {(r["_lang"], r["_rank"]): r["count"] for r in rated.groupBy("_lang", "_rank").count().collect()}  # a row per language and rank
    share = F.lit(0.0)
    for code in LANGUAGES:
        room = SAMPLE
        for rank in range(3):
            n = counts.get((code, rank), 0)
            if n and room:
                share = F.when((F.col("_lang") == code) & (F.col("_rank") == rank), F.lit(min(1.0, room / n))).otherwise(share)
                room -= min(room, n)
    dice = (F.xxhash64(F.lit(7), "_k").bitwiseAND(F.lit((1 << 30) - 1))) / float(1 << 30)
    picked = rated.where(dice < share).limit(2 * SAMPLE * len(LANGUAGES)).select("_k", "_lang")
    texts = tickets.select(F.col(id_col).alias("_k"), *[F.col(c).cast("string").alias(f"_t{i}") for i, c in enumerate(text_cols)]).join(F.broadcast(picked), "_k")
    texts = texts.groupBy("_k", "_lang").agg(*[F.min(f"_t{i}") for i in range(len(text_cols))])  # a row per id, however often it comes
    rows = sorted((r[0], t, r[1]) for r in texts.collect() for t in r[2:] if t)
    discard(rated)
    seen_in = Counter((w, code) for _, t, code in rows for w in {w for line in sentences(t) for w in line.split()})
    vocabulary = {w for (w, _), n in seen_in.items() if n >= KNOWN}.union(*_common.values())
    words = Words(vocabulary)
    out = {}
    for code in LANGUAGES:
        seen: dict[str, None] = {}
        size = 0
        for _, t, own in rows:
            for s in sentences(t, words) if own == code and size < DICTIONARY else ():
                if s not in seen and size < DICTIONARY and _likely(s) == code:
                    seen[s] = None
                    size += len(s.encode()) + 1
        out[code] = "\n".join([*seen, *sentences(PROSE[code]), COMMON[code]]).encode()
    return out, vocabulary


def detect_languages(
    tickets: DataFrame, audit: DataFrame, review: DataFrame, id_col: str = "source_row_id", text_col: str = "body", label_col: str = "language", sample_cols: tuple[str, ...] = ("body", "answer"),
) -> DataFrame:
    """(id_col, label, segment_no, lang, confidence): a row per stretch of one language, in order from 1; label is the declared one in two letters.

    Confidence is the share that the stretch's win has in itself plus NARROW.
    A text in one language whose win is below NARROW takes, in this order, the
    reviewer's language, the confident detector's, the label's, if that loses
    less than NARROW. Null and empty texts and texts without words have no
    row; rows that come twice count once; a null id is left out; empty tables
    give none. Whole texts are read.
    """
    spark = tickets.sparkSession
    texts = spark.sparkContext.broadcast(dictionaries(tickets, audit, id_col, list(sample_cols), label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*texts.value)
        for b in batches:
            langs, wins, losses = judge.stretches(b.column("text").to_pylist())
            langs = [[LANGUAGES[i] for i in x] for x in langs]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(langs, pa.list_(pa.string())), pa.array(wins, pa.list_(pa.float64())), pa.array(losses, pa.list_(pa.float64()))], names=["id", "label", "langs", "wins", "losses"])

    named = tickets.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), label_language(F.col(label_col)).alias("label"), F.col(text_col).cast("string").alias("text"))
    judged = written(named.mapInArrow(run, "id bigint, label string, langs array<string>, wins array<double>, losses array<double>").where(F.size("langs") > 0), "languages").distinct()
    seen = audit.groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max_by(label_language(F.col("detected_language")), "language_confidence").alias("detected"), F.max("language_confidence").alias("sure"))
    manual = review.where("manual_language is not null").groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.min(label_language(F.col("manual_language"))).alias("manual"))
    joined = judged.join(seen, "id", "left").join(manual, "id", "left")
    hint = F.coalesce("manual", F.when(F.col("sure") >= 0.9, F.col("detected")), "label", "detected")
    place = F.array_position(F.array(*[F.lit(x) for x in LANGUAGES]), hint)
    lost = F.when(place > 0, F.element_at("losses", place.cast("int")))
    use_hint = (F.size("langs") == 1) & (F.element_at("wins", 1) < NARROW) & (lost < NARROW)
    decided = joined.withColumn("langs", F.when(use_hint, F.array(hint)).otherwise(F.col("langs")))
    rows = decided.select("id", "label", F.posexplode(F.arrays_zip("langs", "wins")).alias("at", "s"))
    won = F.greatest(F.col("s.wins"), F.lit(0.0))
    return rows.select(F.col("id").alias(id_col), "label", (F.col("at") + 1).cast("bigint").alias("segment_no"), F.col("s.langs").alias("lang"), (won / (won + NARROW)).alias("confidence"))


def label_defects(segments: DataFrame, id_col: str = "source_row_id") -> DataFrame:
    """The segments of texts whose label is missing, names another language, or that hold several languages."""
    kinds = segments.groupBy(id_col).agg(F.count("*").alias("n"), F.min("lang").alias("one"), F.min("label").alias("l"))
    wrong = kinds.where((F.col("n") > 1) | F.col("l").isNull() | (F.col("l") != F.col("one"))).select(id_col)
    return segments.join(wrong, id_col)
