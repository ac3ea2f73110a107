"""Residue, languages and defective pairs on held-out and hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from ticketloom.llm import language, pairs, residue

NAMES = ["Velmo", "Trosk", "Abrint", "Quaddle", "Mirsten", "Hobak"]
EN = ["The printer on the second floor does not answer since {d} o'clock.", "We have restarted the computer of {n} but the fault remains.", "Could you please check whether the licence for {n} is still valid?", "Our team cannot open the file because {n} shows error {d}.", "So far {d} orders are waiting and the customer has asked twice.", "Please tell us when the new version of {n} will be ready."]
DE = ["Der Drucker im zweiten Stock antwortet seit {d} Uhr nicht mehr.", "Wir haben den Rechner von {n} neu gestartet, aber der Fehler bleibt.", "Könnten Sie bitte prüfen, ob die Lizenz für {n} noch gültig ist?", "Unsere Gruppe kann die Datei nicht öffnen, weil {n} den Fehler {d} zeigt.", "Bisher warten {d} Aufträge und der Kunde hat schon zweimal gefragt.", "Bitte sagen Sie uns, wann die neue Fassung von {n} fertig ist."]
FR = ["Depuis hier nous ne pouvons plus ouvrir le fichier de {n}.", "Nous avons redémarré le poste mais la panne est toujours là.", "Merci de vérifier la licence {d} dès que possible."]
ANSWER = {"en": ["Thank you for your message about {n}.", "We have reset the account and a new sign-in is enough.", "The queue of {n} held {d} old jobs, which we removed.", "Let us know whether everything works as expected now."], "de": ["Vielen Dank für Ihre Meldung zu {n}.", "Wir haben das Konto zurückgesetzt, eine neue Anmeldung genügt.", "In der Warteschlange von {n} lagen {d} alte Aufträge, die wir entfernt haben.", "Geben Sie uns bitte Bescheid, ob nun alles wie erwartet arbeitet."]}


def said(rng, lines, k):
    return " ".join(x.format(n=rng.choice(NAMES), d=rng.randint(2, 900)) for x in rng.sample(lines, min(k, len(lines))))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    rows, audit = [], []
    for i in range(400):
        lang = rng.choice(["en", "de"])
        rows.append((i, f"Request {rng.randint(10, 99)} {rng.choice(NAMES)}", said(rng, EN if lang == "en" else DE, rng.randint(3, 6)), said(rng, ANSWER[lang], 4), lang, "x"))
        audit.append((i, lang, 0.999))
    return rows, audit


SCHEMA = "source_row_id bigint, subject string, body string, answer string, language string, id string"


def frames(spark, rows, audit):
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(audit, "source_row_id bigint, detected_language string, language_confidence double")


RESIDUE = {
    1001: ("Printer", "Hello {{first_name}}, we have a problem with ${device}.", {"body"}), 1002: ("lorem ipsum", "Our printer does not answer any more, please help.", {"subject"}),
    1003: ("Fault", "404 Not Found. The page Velmo you asked for does not exist on this server.", {"body"}), 1004: ("Fault", "<noscript>JavaScript is disabled. This page needs scripts to work.</noscript>", {"body"}),
    1005: ("[subject]", "asdf asdf jklö jklö asdf qwertz 12", {"subject", "body"}), 1006: ("Label", "The label prints [customer] in place of the buyer, please mend the template for our team.", set()),
    1007: ("Portal", "Every page of our portal answers 404 not found when we pick Velmo, although the menu still lists it. We need help.", set()), 1008: ("Call", "Dear team, call me under <tel_num>, regards <name>. Our printer is broken.", set()),
    1009: (None, None, set()), 1010: ("", "  ", set()), 1011: ("Fault", "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod.", {"body"}), 1012: ("Enter your subject", "Invoice 12 is missing", {"subject"}),
}


def test_residue(spark, corpus):
    rows, audit = corpus
    extra = [(i, s, b, "a", "en", "x") for i, (s, b, _) in RESIDUE.items()]
    df, _ = frames(spark, rows + extra + extra[:2] + [(None, "lorem ipsum", "lorem ipsum", "", "", "")], audit)
    got = [tuple(r) for r in residue.residue(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, f) for i, (_, _, fs) in RESIDUE.items() for f in fs}
    clean = residue.without_residue(df, residue.residue(df))
    assert clean.where("source_row_id in (1001, 1002)").isEmpty() and clean.where("source_row_id = 1006").count() == 1
    assert residue.residue(df.limit(0)).isEmpty()


def test_one_edit_of_a_mark_is_proper():
    assert all(residue._near_proper(x) for x in ("name", "naem", "nme", "tel_nmu", "email_address"))
    assert not any(residue._near_proper(x) for x in ("date", "customer", "first_name"))


def test_languages(spark, corpus):
    rows, audit = corpus
    rng = random.Random(5)
    mixed = said(rng, EN, 3) + "\n" + said(rng, DE, 3)
    french = said(rng, FR, 3)
    extra = [(2001, None, mixed, "", "en", ""), (2002, None, french, "", "en", ""), (2003, None, said(rng, DE, 3), "", None, ""), (2004, None, said(rng, DE, 3), "", "Deutsch ", ""), (2005, None, said(rng, EN, 3), "", "??", ""), (2006, None, None, "", None, ""), (2007, None, " 12 ", "", None, "")]
    df, a = frames(spark, rows + extra + extra[:1], audit)
    review = spark.createDataFrame([(2003, "de"), (2003, None)], "source_row_id bigint, manual_language string")
    seg = language.detect_languages(df, a, review)
    got = {}
    for r in seg.orderBy("segment_no").collect():
        got.setdefault(r["source_row_id"], []).append(r["lang"])
        assert 0 <= r["confidence"] <= 1
    assert all(got[i] == [lang] for i, _, _, _, lang, _ in rows)
    assert got[2001] == ["en", "de"] and got[2002] == ["fr"] and got[2003] == ["de"] and got[2005] == ["en"] and 2006 not in got and 2007 not in got
    assert {r["source_row_id"] for r in language.label_defects(seg).collect()} == {2001, 2002, 2003, 2005}
    assert language.detect_languages(df.limit(0), a.limit(0), review.limit(0)).isEmpty()


def test_label_spellings(spark):
    rows = [("en-GB", "en"), (" de", "de"), ("Français", "fr"), ("português", "pt"), ("Dutch", "nl"), ("xx", None), ("", None), (None, None), ("und", None), ("de_AT", "de"), ("España?", None)]
    got = [r[0] for r in spark.createDataFrame([(a,) for a, _ in rows], "x string").select(language.label_language(F.col("x"))).collect()]
    assert got == [b for _, b in rows]


def test_pairs(spark, corpus):
    rows, audit = corpus
    rng = random.Random(6)
    body = said(rng, EN, 5)
    good = said(rng, ANSWER["en"], 4)
    cases = {
        3001: (None, "empty"), 3002: ("", "empty"), 3003: ("<p></p>", "empty"), 3004: ("Dear <name>,\n\nKind regards", "empty"), 3005: ("n/a", "empty"), 3006: ("\\n\\n", "empty"),
        3011: (good[:-12], "truncated"), 3012: ("Please do this.\n1. Restart the machine.\n2.", "truncated"), 3013: (good[:60] + "...", "truncated"),
        3021: ("I'm sorry, but I can't help with that.", "refusal"), 3022: ("Dear <name>, I am not able to assist with this request. Thank you for your understanding.", "refusal"), 3023: ("Es ist mir nicht möglich, Ihrer Bitte nachzukommen.", "refusal"),
        3031: (body, "copy"), 3032: ("> " + body.replace(". ", ".\n> "), "copy"), 3033: (body.upper(), "copy"), 3034: (body[: len(body) // 2 + 20], "copy"),
        3041: (said(rng, ANSWER["de"], 4), "other_language"), 3042: ("Dear <name>, " + said(rng, ANSWER["de"], 3), "other_language"),
        3051: (good, None), 3052: (good + " Kind regards\nService team", None), 3053: ("You wrote: \"" + body.split(". ")[0] + ".\" " + good, None), 3054: (good + " Case 712905", None), 3055: ("Done, the change for Velmo is in place.", None),
        3056: ("We cannot see any fault on our side, so the line to Trosk is the likely reason. " + good, None),
    }
    extra = [(i, "Printer", body, a, "en", "") for i, (a, _) in cases.items()]
    df, a = frames(spark, rows + extra + extra[:3] + [(3060, None, None, good, None, ""), (None, "s", body, None, "en", "")], audit)
    found = pairs.broken_pairs(df, a)
    got = {r["source_row_id"]: r["defect_type"] for r in found.collect()}
    assert got == {i: k for i, (_, k) in cases.items() if k}
    assert found.count() == len(got)
    assert pairs.broken_pairs(df.limit(0), a.limit(0)).isEmpty()


def test_lcs():
    assert pairs.lcs(list("abcde"), list("xaxcxe")) == 3
    assert pairs.lcs([], list("a")) == 0 and pairs.lcs(list("aa"), list("aaa")) == 2


# Written without sight of the kinds, dictionaries and test tables; the first 25 refusals were then used to find missing words, the others were not.
REFUSALS = """
I regret that I can't be of assistance in this matter.
We're unable to give any information about that.
That falls outside what I'm allowed to talk about.
I won't be able to respond to this.
Sorry, this is something we do not support. Have a nice day.
My policy prevents me from answering.
Your inquiry can't be handled here.
I respectfully decline.
I do not wish to comment.
We cannot advise you on this topic. Please ask someone else.
Darüber darf ich leider nicht sprechen.
Wir können Ihnen hierzu keine Hilfe anbieten.
Auf solche Fragen antworte ich nicht.
Ich sehe mich außerstande, Ihnen zu helfen.
Diese Anfrage wird nicht bearbeitet.
Bitte haben Sie Verständnis, dass ich dazu nichts sagen kann.
Es tut uns leid, wir geben keine Auskunft.
Das gehört nicht zu den Themen, über die ich reden darf.
Lo sentimos, no podemos ayudarle con este asunto.
No estoy autorizado a responder.
Je regrette, mais je ne peux rien dire à ce sujet.
Nous ne traitons pas ce type de demande.
Mi dispiace, non sono autorizzato a rispondere.
Het spijt ons, wij geven hierover geen informatie.
Lamento, mas não estou autorizado a falar sobre isso.
I'm not comfortable answering this.
We are sorry, but we cannot process requests of this type.
It isn't possible for us to comment on that.
I shall not be discussing this any further.
There is nothing I can tell you about this.
This request has been rejected.
Regrettably, I am in no position to share such information.
As a language model I have no permission to reply to this.
Dabei können wir nicht behilflich sein.
Ich werde diese Frage nicht beantworten.
Bedaure, dazu darf ich nichts mitteilen.
Eine Bearbeitung Ihres Anliegens lehnen wir ab.
Als Assistent bin ich nicht befugt, darüber zu sprechen.
No me es posible contestar a esa pregunta.
Je ne suis pas en mesure de vous répondre.
Non posso fornire queste informazioni.
Ik mag deze vraag niet beantwoorden.
Não me é possível responder a essa pergunta.
""".strip().split("\n")
REPLIES = """
We cannot reproduce the crash, but the new driver should fix it.
Please do not answer the first prompt; choose cancel instead.
The gateway refused the certificate because it had expired.
No, the licence for the scanner is not included in this plan.
If that does not help, please send us the log of the last start.
Unfortunately the part is out of stock, so the repair takes until Friday.
Leider ist der Server bis morgen nicht erreichbar, danach läuft alles wieder.
Sie können die Rechnung nicht ändern, aber wir stellen gern eine neue aus.
Wenn das nicht hilft, rufen Sie bitte den Bereitschaftsdienst an.
Die Anwendung antwortet nicht, weil der Speicher voll ist.
""".strip().split("\n")
LONG_REFUSAL = "Thank you for your message. " * 4 + "I am sorry for the inconvenience this may cause you. " * 4 + "However, I am not allowed to discuss it."
FOREIGN = {
    "es": ["El mes que viene vamos a trasladar la oficina a otro edificio. ¿Quién se encarga de los muebles?", "Mi hermana perdió el móvil en el autobús y no encuentra los contactos.", "La reunión empieza a las nueve, pero la sala todavía está ocupada.", "Hace falta papel en la bandeja y nadie contesta cuando llamamos.", "Quiero devolver los zapatos porque me quedan pequeños."],
    "fr": ["Le mois prochain nous allons déménager dans un autre bâtiment. Qui s'occupe des meubles ?", "Ma sœur a perdu son portable dans le bus et ne retrouve plus ses contacts.", "La réunion commence à neuf heures, mais la salle est encore occupée.", "Il manque du papier dans le bac et personne ne répond quand nous appelons.", "Je veux rendre les chaussures parce qu'elles sont trop petites."],
    "it": ["Il mese prossimo ci trasferiamo in un altro palazzo. Chi si occupa dei mobili?", "Mia sorella ha perso il cellulare in autobus e non trova più i contatti.", "La riunione comincia alle nove, ma la sala è ancora occupata.", "Manca la carta nel cassetto e nessuno risponde quando chiamiamo.", "Voglio restituire le scarpe perché mi stanno piccole."],
    "nl": ["Volgende maand verhuizen we naar een ander gebouw. Wie zorgt er voor de meubels?", "Mijn zus heeft haar mobieltje in de bus verloren en vindt haar contacten niet meer.", "De vergadering begint om negen uur, maar de zaal is nog bezet.", "Er is geen papier meer in de lade en niemand neemt op als we bellen.", "Ik wil de schoenen terugsturen omdat ze te klein zijn."],
    "pt": ["No próximo mês vamos mudar para outro edifício. Quem trata dos móveis?", "A minha irmã perdeu o telemóvel no autocarro e não encontra os contactos.", "A reunião começa às nove, mas a sala ainda está ocupada.", "Falta papel na gaveta e ninguém atende quando ligamos.", "Quero devolver os sapatos porque me ficam pequenos."],
}


def test_refusals_in_other_words():
    for part in (REFUSALS[:25], REFUSALS[25:]):
        found = [x for x in part if pairs.is_refusal(x)]
        assert len(found) >= 0.9 * len(part), sorted(set(part) - set(found))
    assert not [x for x in REPLIES if pairs.is_refusal(x)]
    assert pairs.is_refusal(LONG_REFUSAL)


def test_short_copies():
    assert pairs.is_copy("Printer fault", "Printer fault\nIt does not print.") and pairs.is_copy("It prints!", "Fault\nIt prints. But badly.")
    assert not pairs.is_copy("Done.", "Fault\nThis must be done today.") and not pairs.is_copy("", "x") and not pairs.is_copy("Yes", "")
    assert pairs.is_copy("one two x three four y five six z seven eight nine", "one two three four five six seven eight nine ten")


def test_foreign_texts_of_another_author(spark, corpus):
    rows, audit = corpus
    extra = [(4000 + 10 * i + k, "", t, "", None, "") for i, lang in enumerate(FOREIGN) for k, t in enumerate(FOREIGN[lang])]
    df, a = frames(spark, rows + extra, audit)
    got = {}
    for r in language.detect_languages(df, a, spark.createDataFrame([], "source_row_id bigint, manual_language string")).where("source_row_id >= 4000").collect():
        got.setdefault(r["source_row_id"], []).append(r["lang"])
    right = sum(got.get(4000 + 10 * i + k) == [lang] for i, lang in enumerate(FOREIGN) for k in range(5))
    assert right >= 0.9 * len(extra), got


def test_costs_are_those_of_every_dictionary(spark, corpus):
    rows, audit = corpus
    df, a = frames(spark, rows, audit)
    judge = language.Judge(*language.dictionaries(df, a, "source_row_id", ["body", "answer"], "language"))
    texts = [r[2] for r in rows] + ["", "12"] + [r[2] for r in rows[:50]]
    table, counts = judge.costs(texts)
    lines = [x.encode() for t in texts for x in language.sentences(t, judge._words)]
    assert counts.tolist() == [len(language.sentences(t, judge._words)) for t in texts]
    assert table.tolist() == [[len(f(x)) for f in judge._use] for x in lines]
