"""Plain text of seven languages, with which language dictionaries begin.

Written for this package and not taken from any corpus, but for the articles
of the Universal Declaration of Human Rights at the beginning of each text.
"""

# The same text in each language.
PROSE = {
    "de": """Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen. Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person. Jeder hat das Recht auf Arbeit, auf freie Berufswahl, auf gerechte und befriedigende Arbeitsbedingungen sowie auf Schutz vor Arbeitslosigkeit. Jeder hat das Recht auf Bildung. Jeder hat das Recht auf Erholung und Freizeit und insbesondere auf eine vernünftige Begrenzung der Arbeitszeit und regelmäßigen bezahlten Urlaub.
Heute Morgen nahm ich den Zug in die Stadt, weil mein Auto nicht ansprang. Das Geschäft an der Ecke schließt um sechs, also sollten wir vor dem Abendessen dorthin gehen. Obwohl es die ganze Woche regnete, spielten die Kinder jeden Nachmittag im Garten. Sie hat mir erzählt, dass ihr Bruder seit zehn Jahren im Ausland lebt. Wenn Sie Fragen haben, rufen Sie uns einfach an oder schreiben Sie uns. Wir haben Ihren Brief vergangene Woche erhalten und werden innerhalb weniger Tage antworten. Leider musste die Besprechung abgesagt werden, weil mehrere Leute krank waren. Das neue Modell ist schneller als das alte, kostet aber auch viel mehr. Bevor du das Zimmer verlässt, mach das Licht aus und schließe die Fenster. Niemand wusste, wer die Schlüssel auf dem Tisch gelassen hatte. Ich möchte meine Anschrift ändern und die zweite Bestellung stornieren. Der Bildschirm bleibt nach der Aktualisierung schwarz, und die Tastatur reagiert nicht. Mein Konto wurde gesperrt, obwohl ich die richtigen Daten eingegeben habe. Welche Einstellungen brauche ich, damit Nachrichten auch auf meinem Telefon ankommen? Der Kunde wartet auf die Lieferung, die am Montag hätte kommen sollen.""",
    "en": """All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Everyone has the right to life, liberty and security of person. Everyone has the right to work, to free choice of employment, to just and favourable conditions of work and to protection against unemployment. Everyone has the right to education. Everyone has the right to rest and leisure, including reasonable limitation of working hours and periodic holidays with pay.
This morning I took the train to the city because my car would not start. The shop on the corner closes at six, so we should go there before dinner. Although it rained the whole week, the children played in the garden every afternoon. She told me that her brother has been living abroad for ten years. If you have any questions, do not hesitate to call or write to us. We received your letter last week and will reply within a few days. Unfortunately the meeting had to be cancelled because several people were ill. The new model is faster than the old one, but it also costs a lot more. Before you leave the room, turn off the light and close the windows. Nobody knew who had left the keys on the table. I would like to change my address and cancel the second order. The screen stays black after the update, and the keyboard does not respond. My account has been locked although I entered the right data. Which settings do I need so that messages arrive on my phone as well? The customer is waiting for the delivery, which should have come on Monday.""",
    "es": """Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona. Toda persona tiene derecho al trabajo, a la libre elección de su trabajo, a condiciones equitativas y satisfactorias de trabajo y a la protección contra el desempleo. Toda persona tiene derecho a la educación. Toda persona tiene derecho al descanso, al disfrute del tiempo libre, a una limitación razonable de la duración del trabajo y a vacaciones periódicas pagadas.
Esta mañana tomé el tren a la ciudad porque mi coche no arrancaba. La tienda de la esquina cierra a las seis, así que deberíamos ir antes de la cena. Aunque llovió toda la semana, los niños jugaron en el jardín todas las tardes. Ella me contó que su hermano vive en el extranjero desde hace diez años. Si tiene alguna pregunta, no dude en llamarnos o escribirnos. Recibimos su carta la semana pasada y responderemos dentro de unos días. Por desgracia hubo que cancelar la reunión porque varias personas estaban enfermas. El modelo nuevo es más rápido que el antiguo, pero también cuesta mucho más. Antes de salir de la habitación, apaga la luz y cierra las ventanas. Nadie sabía quién había dejado las llaves sobre la mesa. Quisiera cambiar mi dirección y anular el segundo pedido. La pantalla se queda negra después de la actualización y el teclado no responde. Mi cuenta ha sido bloqueada aunque introduje los datos correctos. ¿Qué ajustes necesito para que los mensajes lleguen también a mi teléfono? El cliente espera la entrega, que tendría que haber llegado el lunes.""",
    "fr": """Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne. Toute personne a droit au travail, au libre choix de son travail, à des conditions équitables et satisfaisantes de travail et à la protection contre le chômage. Toute personne a droit à l'éducation. Toute personne a droit au repos et aux loisirs et notamment à une limitation raisonnable de la durée du travail et à des congés payés périodiques.
Ce matin j'ai pris le train pour aller en ville parce que ma voiture ne démarrait pas. Le magasin du coin ferme à six heures, nous devrions donc y aller avant le dîner. Bien qu'il ait plu toute la semaine, les enfants ont joué dans le jardin chaque après-midi. Elle m'a raconté que son frère vit à l'étranger depuis dix ans. Si vous avez des questions, n'hésitez pas à nous appeler ou à nous écrire. Nous avons reçu votre lettre la semaine dernière et nous répondrons d'ici quelques jours. Malheureusement la réunion a dû être annulée parce que plusieurs personnes étaient malades. Le nouveau modèle est plus rapide que l'ancien, mais il coûte aussi beaucoup plus cher. Avant de quitter la pièce, éteins la lumière et ferme les fenêtres. Personne ne savait qui avait laissé les clés sur la table. Je voudrais changer mon adresse et annuler la deuxième commande. L'écran reste noir après la mise à jour et le clavier ne répond pas. Mon compte a été bloqué alors que j'ai saisi les bonnes données. De quels réglages ai-je besoin pour que les messages arrivent aussi sur mon téléphone ? Le client attend la livraison qui aurait dû arriver lundi.""",
    "it": """Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Ogni individuo ha diritto alla vita, alla libertà ed alla sicurezza della propria persona. Ogni individuo ha diritto al lavoro, alla libera scelta dell'impiego, a giuste e soddisfacenti condizioni di lavoro ed alla protezione contro la disoccupazione. Ogni individuo ha diritto all'istruzione. Ogni individuo ha diritto al riposo ed allo svago, comprendendo in ciò una ragionevole limitazione delle ore di lavoro e ferie periodiche retribuite.
Stamattina ho preso il treno per andare in città perché la mia macchina non partiva. Il negozio all'angolo chiude alle sei, quindi dovremmo andarci prima di cena. Anche se è piovuto tutta la settimana, i bambini hanno giocato in giardino ogni pomeriggio. Lei mi ha raccontato che suo fratello vive all'estero da dieci anni. Se avete domande, non esitate a chiamarci o a scriverci. Abbiamo ricevuto la sua lettera la settimana scorsa e risponderemo entro pochi giorni. Purtroppo la riunione è stata annullata perché diverse persone erano malate. Il nuovo modello è più veloce di quello vecchio, ma costa anche molto di più. Prima di lasciare la stanza, spegni la luce e chiudi le finestre. Nessuno sapeva chi avesse lasciato le chiavi sul tavolo. Vorrei cambiare il mio indirizzo e annullare il secondo ordine. Lo schermo resta nero dopo l'aggiornamento e la tastiera non risponde. Il mio conto è stato bloccato anche se ho inserito i dati giusti. Di quali impostazioni ho bisogno perché i messaggi arrivino anche sul mio telefono? Il cliente aspetta la consegna che sarebbe dovuta arrivare lunedì.""",
    "nl": """Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. Een ieder heeft het recht op leven, vrijheid en onschendbaarheid van zijn persoon. Een ieder heeft recht op arbeid, op vrije keuze van beroep, op rechtvaardige en gunstige arbeidsvoorwaarden en op bescherming tegen werkloosheid. Een ieder heeft recht op onderwijs. Een ieder heeft recht op rust en op eigen vrije tijd, met inbegrip van een redelijke beperking van de arbeidstijd, en op periodieke vakanties met behoud van loon.
Vanmorgen nam ik de trein naar de stad omdat mijn auto niet wilde starten. De winkel op de hoek sluit om zes uur, dus we zouden er voor het avondeten heen moeten gaan. Hoewel het de hele week regende, speelden de kinderen elke middag in de tuin. Ze vertelde me dat haar broer al tien jaar in het buitenland woont. Als u vragen heeft, aarzel dan niet om ons te bellen of te schrijven. Wij hebben uw brief vorige week ontvangen en zullen binnen enkele dagen antwoorden. Helaas moest de vergadering worden afgezegd omdat verschillende mensen ziek waren. Het nieuwe model is sneller dan het oude, maar het kost ook veel meer. Voordat je de kamer verlaat, doe het licht uit en sluit de ramen. Niemand wist wie de sleutels op de tafel had laten liggen. Ik zou graag mijn adres wijzigen en de tweede bestelling annuleren. Het scherm blijft zwart na de update en het toetsenbord reageert niet. Mijn account is geblokkeerd hoewel ik de juiste gegevens heb ingevoerd. Welke instellingen heb ik nodig zodat berichten ook op mijn telefoon aankomen? De klant wacht op de levering, die maandag had moeten komen.""",
    "pt": """Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Todo o indivíduo tem direito à vida, à liberdade e à segurança pessoal. Toda a pessoa tem direito ao trabalho, à livre escolha do trabalho, a condições equitativas e satisfatórias de trabalho e à proteção contra o desemprego. Toda a pessoa tem direito à educação. Toda a pessoa tem direito ao repouso e aos lazeres, especialmente a uma limitação razoável da duração do trabalho e a férias periódicas pagas.
Esta manhã apanhei o comboio para a cidade porque o meu carro não pegava. A loja da esquina fecha às seis, por isso devíamos lá ir antes do jantar. Embora tenha chovido a semana inteira, as crianças brincaram no jardim todas as tardes. Ela contou-me que o irmão vive no estrangeiro há dez anos. Se tiver alguma pergunta, não hesite em telefonar ou escrever para nós. Recebemos a sua carta na semana passada e vamos responder dentro de poucos dias. Infelizmente a reunião teve de ser cancelada porque várias pessoas estavam doentes. O modelo novo é mais rápido do que o antigo, mas também custa muito mais. Antes de sair do quarto, apaga a luz e fecha as janelas. Ninguém sabia quem tinha deixado as chaves em cima da mesa. Eu queria mudar a minha morada e cancelar a segunda encomenda. O ecrã fica preto depois da atualização e o teclado não responde. A minha conta foi bloqueada embora eu tenha introduzido os dados certos. De que definições preciso para que as mensagens cheguem também ao meu telefone? O cliente está à espera da entrega, que devia ter chegado na segunda-feira.""",
}
