"""Invented sentences with personal information of nobody, for training the tagger: every piece with its kind and place."""

from __future__ import annotations

import random

_ONSET = ("b", "br", "c", "ch", "d", "dr", "f", "fr", "g", "gr", "h", "j", "k", "kl", "l", "m", "n", "p", "pr", "qu", "r", "s", "sch", "st", "t", "tr", "v", "w", "y", "z", "")
_VOWEL = ("a", "e", "i", "o", "u", "ei", "au", "ia", "ie", "é", "ö", "á", "ü")
_CODA = ("", "", "l", "n", "r", "s", "m", "ck", "nd", "rt", "x", "sk", "ne", "le", "ll", "th", "ng")
_ENDING = ("", "", "", "son", "er", "mann", "ez", "ov", "ini", "eau", "ton", "ley", "ström", "berg", "wick", "ier", "a", "o")

# Common given and family names, so that real ones are met too.
_GIVEN = ("Maria", "Anna", "John", "Peter", "Lucía", "Jean-Luc", "Karl", "Hans", "Zoë", "Ahmed", "Wei", "Olga", "Tom", "Élodie", "Jürgen", "Sofía", "Pedro", "Claire", "Emma", "Paul")
_FAMILY = ("Keller", "Schmidt", "Smith", "Müller", "García", "Lopez", "Dubois", "Martin", "Brown", "Nguyen", "Rossi", "Novák", "Weber", "Moreau", "Jones", "Fischer", "Torres", "Petit", "Khan", "Becker")
_PARTICLE = ("von", "van", "de", "de la", "del", "du", "van der", "di", "zu")

# Sentences around a name ({n}), with an optional title before it ({t}), by language.
_NAMES = {
    "en": (
        "We met {t}{n} at the station", "Thanks, {n}", "Best wishes, {n}", "Kind regards,\n{n}", "{n} called this morning", "I spoke with {t}{n} yesterday", "According to {t}{n} it was late",
        "{n} and {n} wrote the report", "Minutes taken by {n}", "The patient, {t}{n}, was seen on Monday", "{n} is our new colleague", "Hi {n}, thank you", "cc: {n}", "Responsible: {n}", "{n} filled in the sheet",
        "Applicant: {n}", "{n} (born 1980) moved", "Please forward this to {t}{n}", "{n} agreed in writing", "{n} put a signature below", "Written by {n} in May", "Hello {t}{n}, see below", "her name is {n}", "this is {n} speaking",
        "The sample of {n} was lost", "Ask for {n} at the desk", "{n}'s samples arrived", "{t}{n} will be away", "I am {n} and I work here", "Reviewed: {n}", "Name: {n}", "Yours faithfully\n{n}", "{n} approved it", "Dear {t}{n}, the file is here", "Yesterday {n} came by", "Then {n} left", "On Friday {n} paid", "Monday: {n} on duty", "Dear {n}", "The keys are with {t}{n} now", "With {n} gone, nothing moved",
    ),
    "de": (
        "Wir trafen {t}{n} am Bahnhof", "Danke, {n}", "Viele Grüße\n{n}", "{n} rief heute an", "Ich sprach gestern mit {t}{n}", "Laut {t}{n} war es zu spät", "{n} und {n} schrieben den Bericht", "Protokoll: {n}", "Die Patientin {n} kam am Montag",
        "{n} ist neu im Haus", "Hallo {n}, vielen Dank", "Zuständig: {n}", "{n} füllte den Bogen aus", "Antragsteller: {n}", "Bitte weiterleiten an {t}{n}", "{n} stimmte schriftlich zu", "{n} setzte den Namen darunter", "Verfasst von {n} im Mai", "Sehr geehrte {t}{n}, anbei",
        "sie heißt {n}", "hier spricht {n}", "Die Probe von {n} ging verloren", "Fragen an {t}{n}", "{t}{n} ist im Urlaub", "Ich bin {n} und arbeite hier", "Geprüft: {n}", "Name: {n}", "Hochachtungsvoll\n{n}", "mein Name ist {n}", "{n} hat zugesagt", "Lieber {n}, danke", "Dank an {t}{n} für die Hilfe", "Die Unterschrift stammt von {n}", "Gestern kam {n} vorbei", "Der Schlüssel liegt bei {t}{n} seit Mai", "Meldung durch {n}", "Am Freitag zahlte {n}", "Auch {t}{n} war dabei",
    ),
    "fr": (
        "Nous avons vu {t}{n} à la gare", "Merci, {n}", "Bien à vous, {n}", "{n} a appelé ce matin", "J'ai parlé hier avec {t}{n}", "Selon {t}{n} il était tard", "{n} et {n} ont écrit le rapport", "Compte rendu : {n}", "La patiente, {t}{n}, est venue lundi", "{n} est notre collègue",
        "Bonjour {n}, merci", "Responsable : {n}", "{n} a rempli le questionnaire", "Demandeur : {n}", "À transmettre à {t}{n}", "{n} a donné son accord", "{n} a apposé son nom", "Écrit par {n} en mai", "Chère {t}{n}, voici", "elle s'appelle {n}", "ici {n} à l'appareil",
        "L'échantillon de {n} est perdu", "Adressez-vous à {t}{n}", "{t}{n} est en congé", "Je suis {n} et je travaille ici", "Relu : {n}", "Nom : {n}", "Veuillez agréer\n{n}", "je m'appelle {n}", "Merci à {t}{n} pour son aide", "{n} habite ici depuis mai", "La signature est de {n}", "Hier {n} est passé", "La clé est chez {t}{n} depuis mai", "{t}{n} habite en ville", "Avec {n} tout va bien",
    ),
    "es": (
        "Vimos a {t}{n} en la estación", "Gracias, {n}", "Saludos cordiales, {n}", "{n} llamó esta mañana", "Ayer hablé con {t}{n}", "Según {t}{n} era tarde", "{n} y {n} escribieron el informe", "Acta: {n}", "La paciente, {t}{n}, vino el lunes", "{n} es nuestra colega",
        "Hola {n}, gracias", "Responsable: {n}", "{n} rellenó el cuestionario", "Solicitante: {n}", "Reenviar a {t}{n}", "{n} dio su acuerdo", "{n} puso su nombre abajo", "Escrito por {n} en mayo", "Estimada {t}{n}, adjunto", "ella se llama {n}", "habla {n}", "La muestra de {n} se perdió",
        "Consulte a {t}{n}", "{t}{n} está de vacaciones", "Soy {n} y trabajo aquí", "Revisado: {n}", "Nombre: {n}", "Quedo a su disposición\n{n}", "me llamo {n}", "Gracias a {t}{n} por la ayuda", "{n} vive aquí desde mayo", "La firma es de {n}", "Ayer {n} pasó por aquí", "La llave la tiene {t}{n} desde mayo", "Mi vecina {n} lo vio", "Con {n} todo va bien",
    ),
}
_TITLES = {
    "en": ("Mr ", "Mrs ", "Ms ", "Dr ", "Dr. ", "Prof. ", "Mr. ", "Professor "),
    "de": ("Herr ", "Frau ", "Herrn ", "Dr. ", "Prof. ", "Frau Dr. "),
    "fr": ("M. ", "Mme ", "Mlle ", "Dr ", "Pr ", "Madame ", "Monsieur "),
    "es": ("Sr. ", "Sra. ", "Dr. ", "Dra. ", "Don ", "Doña ", "Srta. "),
}
# What a number of a person is called, and sentences around it.
_ID_WORDS = {
    "en": ("SSN", "social security number", "passport", "passport no.", "ID card", "identity number", "national ID", "driver's licence", "driving licence number", "tax number", "national insurance number", "identity card no."),
    "de": ("Ausweisnummer", "Personalausweis", "Reisepass", "Steuer-ID", "Sozialversicherungsnummer", "Führerschein Nr.", "Passnummer", "SV-Nummer"),
    "fr": ("passeport", "passeport n°", "carte d'identité", "numéro de sécurité sociale", "permis de conduire", "n° de sécurité sociale", "numéro fiscal"),
    "es": ("DNI", "NIE", "NIF", "pasaporte", "pasaporte n.º", "documento de identidad", "permiso de conducir", "número de la seguridad social", "carné de conducir"),
}
_ID_FRAMES = {
    "en": ("{c}: {i}", "{c} {i}", "Her {c} is {i}", "his {c} {i} was checked", "{i} ({c})", "{i} is the {c}", "{i} as {c}", "my {c} reads {i}", "the {c} given was {i}", "{i} was entered under {c}"),
    "de": ("{c}: {i}", "{c} {i}", "Ihre {c} lautet {i}", "die {c} {i} wurde geprüft", "{i} ({c})", "{i} als {c}", "mit {c} {i} gemeldet", "{i} ist die {c}"),
    "fr": ("{c} : {i}", "{c} {i}", "son {c} est {i}", "le {c} {i} est valable", "{i} ({c})", "{i} comme {c}", "{i} est le {c}", "mon {c} porte {i}"),
    "es": ("{c}: {i}", "{c} {i}", "su {c} es {i}", "el {c} {i} es válido", "{i} ({c})", "{i} como {c}", "{i} es el {c}", "mi {c} lleva {i}"),
}
_PHONE_FRAMES = {
    "en": ("call me on {p}", "Phone: {p}", "phone {p}", "tel. {p}", "Tel: {p} after six", "reach her at {p}", "{p} (mobile)", "{p} is the office number", "mobile {p}", "ring {p} tomorrow", "fax {p}", "my number is {p}", "dial {p}", "text {p} if late", "({p})", "in case of trouble {p}", "front desk {p}", "{p}, any time"),
    "de": ("rufen Sie {p} an", "Telefon: {p}", "Tel. {p}", "unter {p} erreichbar", "{p} (mobil)", "Handy {p}", "Rufnummer {p}", "meine Nummer ist {p}", "Fax {p}", "Durchwahl {p}", "{p} (privat)", "im Notfall {p}", "bei Fragen {p} anrufen", "Empfang {p}", "{p} wählen"),
    "fr": ("appelez le {p}", "Téléphone : {p}", "tél. {p}", "joignable au {p}", "{p} (portable)", "portable {p}", "mon numéro est le {p}", "fax {p}", "composez le {p}", "numéro {p}", "urgence : {p}", "accueil {p}", "pour réserver : {p}", "en cas de doute : {p}"),
    "es": ("llame al {p}", "Teléfono: {p}", "tel. {p}", "tfno. {p}", "disponible en el {p}", "{p} (móvil)", "móvil {p}", "mi número es el {p}", "fax {p}", "marque el {p}", "en caso de duda, {p}", "urgencias: {p}", "pregunte en el {p}", "recepción {p}", "mande un mensaje al {p}"),
}
_MAIL_FRAMES = {
    "en": ("write to {e}", "mail: {e}", "E-mail {e}", "contact {e} today", "{e} has it", "send it to {e}", "my address is {e}", "from {e}", "(see {e})", "reply to <{e}>", "mailto:{e}", "{e}", "forward it to {e} please", "with a copy to {e}"),
    "de": ("schreiben Sie an {e}", "E-Mail: {e}", "Mail an {e}", "Kontakt {e}", "{e} hat es", "Datei bei {e}", "an {e} schicken", "mit Kopie an {e}", "Antwort an {e} genügt", "<{e}>", "von {e}", "meine Adresse ist {e}"),
    "fr": ("écrivez à {e}", "courriel : {e}", "e-mail {e}", "contact {e}", "fichier chez {e}", "<{e}>", "de {e}", "avec copie à {e}", "à transmettre à {e} vite", "mon adresse est {e}"),
    "es": ("escriba a {e}", "correo: {e}", "e-mail {e}", "contacto {e}", "archivo en {e}", "<{e}>", "de {e}", "con copia a {e}", "envíe el archivo a {e} hoy", "mi correo es {e}"),
}
_HOME_FRAMES = {
    "en": ("lives at {a}, {z}", "Address: {a}, {z}", "send it to {a}, {z}", "{a}, {z}", "moved to {a} in May", "the parcel went to {a}", "delivered to {a}, {z}", "we are at {a}", "home: {a}"),
    "de": ("wohnt in der {a}, {z}", "Anschrift: {a}, {z}", "bitte an {a}, {z}", "{a}, {z}", "zog in die {a}", "Paket an {a}", "wohnhaft {a}, {z}", "Adresse: {a}"),
    "fr": ("habite au {a}, {z}", "Adresse : {a}, {z}", "à envoyer au {a}, {z}", "{a}, {z}", "demeurant {a}", "colis pour le {a}", "domicile : {a}, {z}", "livré {a}"),
    "es": ("vive en {a}, {z}", "Dirección: {a}, {z}", "enviar a {a}, {z}", "{a}, {z}", "con domicilio en {a}", "paquete para {a}", "se mudó a {a}", "entrega en {a}"),
}
# What looks like personal information and is none.
_NOTHING = (
    "Lot {d4}-{d2}-{d3}", "batch {d3} {d3} {d3}", "CAS {d2}-{d2}-{d1}", "order no. {d7}", "Bestellung {d7}", "pedido {d3}-{d4}", "doi 10.{d4}/x.{d4}.{d2}", "ref. {y}/{d2}-{d1}", "plates {d3}-{d3}", "{d3}.{d1} nM", "{d2}–{d2}", "CHEMBL{d7}", "{y}-0{d1}-{d2}",
    "{d1}.{d2}.{y}", "{d3},{d2} %", "{U}{U}{U}-{d4}", "version {d1}.{d1}.{d2}", "ISBN 978-{d1}-{d4}-{d4}-{d1}", "room {d3}", "Invoice {d6}", "Rechnung Nr. {d6}", "facture n° {d6}", "pages {d3}-{d3}", "at {d2} dot blots", "{d1} x {d3}", "IP 10.{d2}.{d3}.{d1}", "The North {W} Institute", "New {W}", "the {W} Street Journal",
    "Santa {W}", "The Blue {W}", "{W} Research Centre", "Der Rote {W}", "Das {W} Verfahren", "Le Grand {W}", "La Casa {W}", "at the counter", "Table {d2}. Results", "Figure {d1}b", "pH {d1}.{d1}", "Plate {U}{d2}", "{W} buffer {d3}", "Dear colleagues", "Liebe Kollegen", "Cher public", "Estimados clientes", "Thank you",
    "Monday Morning", "step {d1} of {d2}", "item {d7}", "Catalogue {d3}-{d3}", "sample {U}{d3}{U}", "Kind regards", "{d3} {d3} cells", "{d2}:{d2} h", "The {W} method", "Please ask about it", "SKU {d4}{U}{d3}", "EC {d1}.{d1}.{d1}.{d2}", "serial number {d4}{U}{U}{d2}", "C{d1}H{d2}O{d1}", "Port {W} Basin", "Mount {W}", "Polymer {W}", "the {W} catalyst", "Rezeptor {W}", "Lake {W} Station", "Radikal {W}", "Cape {W}", "dimère {W}", "{W} {W} cells", "Gasthof {W}", "Hôtel {W}", "plaza {W}", "{d2} The {W}", "{d2} tubes", "{d2} Minuten lang", "{d2} Stunden", "{d2} minutes", "on {y}-0{d1}-{d2}", "sent {y}-0{d1}-{d2}", "{d2} Proben", "after {d3} days", "{d1} cm", "{d2} Grad Celsius", "{d2} jours", "{d2} muestras", "{d3} g", "parcel {d2}-{d4}", "Order {d2}-{d4}", "box {d2} of {d2}",
)
_TYPES = ("Street", "St", "Road", "Rd", "Lane", "Avenue", "Ave", "Crescent", "Close", "Drive", "Way", "Court", "Place", "Square", "Terrace", "Gardens", "Hill", "Row", "St.", "Rd.", "Ave.", "Ln.")
_DOMAINS = ("com", "org", "net", "de", "fr", "es", "co.uk", "example", "test", "invalid", "edu", "io", "info")

Piece = tuple[str, str]  # kind or "", text


def word(rng: random.Random, capital: bool = True) -> str:
    """An invented word that can be spoken."""
    w = "".join(rng.choice(_ONSET) + rng.choice(_VOWEL) + (rng.choice(_CODA) if rng.random() < 0.6 else "") for _ in range(rng.choice((1, 2, 2, 2, 3)))) or "ova"
    w = w if len(w) > 2 else w + "lan"
    return w[0].upper() + w[1:] if capital else w


def _given(rng: random.Random) -> str:
    r = rng.random()
    if r < 0.15:
        return rng.choice(_GIVEN)
    return word(rng) + ("-" + word(rng) if r > 0.96 else "")


def _family(rng: random.Random) -> str:
    r = rng.random()
    w = rng.choice(_FAMILY) if r < 0.15 else word(rng) + rng.choice(_ENDING)
    if r > 0.9:
        w = rng.choice(_PARTICLE) + " " + w
    elif r > 0.84:
        w = rng.choice(("O'", "Mc", "D'", "Mac", "O’", "Saint-", "San-")) + w
    elif r > 0.8:
        w += "-" + word(rng)
    return w


def name(rng: random.Random) -> str:
    r, given, family, initial = rng.random(), _given(rng), _family(rng), rng.choice("ABCDEFGHIJKLMNOPRSTVWYZ") + "."
    if r < 0.55:
        return f"{given} {family}"
    if r < 0.68:
        return f"{given} {initial} {family}"
    if r < 0.84:
        return f"{initial} {family}"
    if r < 0.95:
        return f"{family}, {given}"
    return f"{family}, {initial}"


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _letters(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("ABCDEFGHJKLMNPRSTVWXYZ") for _ in range(n))


def id_number(rng: random.Random) -> str:
    # Shapes of numbers of persons; 9 stands for a digit, A for a capital
    shape = rng.choice(("999-99-9999", "999-99-9999", "AA 999 9999", "AA9999999", "99 999 999 999", "99999999999", "A99A99999", "99999999A", "99.999.999-A", "99999999-A", "A9999999A", "A-9999999-A", "AAA999999AA", "9999A-99999", "AAA999999", "9 99 99 99 999 999 99", "99 999999 A 999", "99999999-9", "99/99999999/99", "A9999999", "999 99 9999", "AA 99 99 99 A", "A9999-99999-99999", "999999999999", "99AA99999"))
    return "".join(_digits(rng, 1) if ch == "9" else _letters(rng, 1) if ch == "A" else ch for ch in shape)


def phone(rng: random.Random) -> str:
    shape = rng.choice(("+99 99 999 99 99", "+999-99-999999", "+999 99 999 99 99", "0099 99 99999 999", "+99 (0)99 99999-999", "099 9999 9999", "(999) 999-9999", "999-999-9999", "09.99.99.99.99", "09 99 99 99 99", "09999 999999", "+9 999 999 9999", "099 99999999", "999 999 999", "+99 9999 999 999", "+99 999 99 99 99", "099/9999999", "099-9999999", "+999999999999", "9999 9999", "(099) 99999-99", "+99.9.99.99.99.99", "0999 999 99 99"))
    return "".join(rng.choice("123456789") if ch == "9" and i < 2 else _digits(rng, 1) if ch == "9" else ch for i, ch in enumerate(shape))


def email(rng: random.Random) -> str:
    sep = rng.choice((".", "_", "-", "+", ".", ""))
    local = rng.choice((f"{word(rng, False)}{sep}{word(rng, False)}", word(rng, False) + _digits(rng, rng.randint(0, 2)), f"{rng.choice('abcdefghjkm')}{sep}{word(rng, False)}", f"{word(rng, False)}.{word(rng, False)}.{_digits(rng, 1)}"))
    host = ".".join([word(rng, False) + (rng.choice(("-research", "-lab", "")) if rng.random() < 0.3 else "") for _ in range(rng.choice((1, 1, 2)))] + [rng.choice(_DOMAINS)])
    plain = "".join(ch if ch.isascii() else "e" for ch in f"{local}@{host}")
    local, host = plain.split("@")
    r = rng.random()
    if r < 0.5:
        out = plain
    elif r < 0.62:
        out = f"{local} at {host}".replace(".", " dot ")
    elif r < 0.74:
        out = f"{local}{rng.choice((' [at] ', '[at]', ' (at) ', '(at)', ' [arroba] '))}{host}"
    elif r < 0.88:
        out = f"{local}{rng.choice((' [at] ', '(at)', ' (at) '))}" + host.replace(".", rng.choice(("(dot)", " [dot] ", " (dot) ", "[punto]")))
    else:
        out = f"{local} @ {host}"
    return out.upper() if rng.random() < 0.06 else out


def address(rng: random.Random, lang: str) -> tuple[str, str]:
    """(street and house number, postcode and town)."""
    n, w, town = str(rng.randint(1, 399)), word(rng), rng.choice(("", "", "Bad ", "Saint-", "San ")) + word(rng)
    zip_ = _digits(rng, 5)
    if lang == "en":
        n += rng.choice(("", "", "", "A", "b"))
        w += " " + word(rng) if rng.random() < 0.1 else ""
        return f"{n}{rng.choice(('', '', '', ','))} {w} {rng.choice(_TYPES)}", rng.choice((f"{town} {zip_}", f"{town} {_letters(rng, 2)}{_digits(rng, 1)} {_digits(rng, 1)}{_letters(rng, 2)}", town))
    if lang == "de":
        n += rng.choice(("", "", "", "a", " b"))
        kind = rng.choice(("straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "ring", "ufer", "damm"))
        street = rng.choice((f"{w}{kind}", f"{w}{kind}", f"{w}{kind}", f"Am {w}", f"An der {w}", f"Im {w}", f"Zum {w}", f"{w}-{word(rng)}-Straße", f"{w}er Straße"))
        return f"{street} {n}", f"{zip_} {town}"
    if lang == "fr":
        n += rng.choice(("", "", "", " bis", " ter"))
        return f"{n}{rng.choice((',', ''))} {rng.choice(('rue', 'rue', 'avenue', 'boulevard', 'place', 'chemin', 'impasse', 'allée', 'quai', 'cours'))} {rng.choice(('', 'de ', 'du ', 'de la ', 'des '))}{w}", f"{zip_} {town}"
    kind = rng.choice(("Calle", "C/", "Avda.", "Avenida", "Paseo", "Plaza", "Camino", "Ronda", "calle", "avenida"))
    return f"{kind} {rng.choice(('', 'de ', 'del ', 'de la '))}{w}{rng.choice((', ', ' ', ', n.º ', ', núm. '))}{n}", f"{zip_} {town}"


def _carrier(rng: random.Random) -> list[Piece]:
    """A piece between invented words, where nothing but its own shape tells what it is; or numbers and names of nothing."""
    some = lambda: " ".join(word(rng, rng.random() < 0.12) for _ in range(rng.randint(1, 4)))
    first = some()
    first = first[0].upper() + first[1:]
    r = rng.random()
    if r < 0.45:
        title = rng.choice(_TITLES[rng.choice(tuple(_TITLES))]) if rng.random() < 0.3 else ""
        middle: list[Piece] = [("", title), ("name", name(rng))]
        first = first if rng.random() < 0.5 else first.lower()
        first = first if title else first.rsplit(" ", 1)[0] + " " + first.rsplit(" ", 1)[-1].lower() if " " in first else first + " " + word(rng, False)
    elif r < 0.65:
        middle = [("email", email(rng))]
    elif r < 0.8:
        number = phone(rng)
        while number[0] not in "+(" and not number.startswith("00"):
            number = phone(rng)
        middle = [("phone", number)]
    else:
        middle = [("", rng.choice((f"{rng.randint(2, 99)} {word(rng, rng.random() < 0.3)}", f"{_digits(rng, 4)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"{_digits(rng, 2)}-{_digits(rng, 4)}", f"{rng.randint(2, 900)} {word(rng, False)} {word(rng, False)}", word(rng))))]
    return [("", first + " "), *middle, ("", rng.choice((" ", " ", ", ")) + some())]


def _fill(frame: str, values: dict[str, list[Piece]]) -> list[Piece]:
    out: list[Piece] = []
    for part in frame.replace("{", "\0{").replace("}", "}\0").split("\0"):
        if part.startswith("{") and part.endswith("}"):
            out += values[part[1:-1]]() if callable(values[part[1:-1]]) else values[part[1:-1]]
        elif part:
            out.append(("", part))
    return out


def sentence(rng: random.Random, lang: str) -> list[Piece]:
    """A sentence in parts: those with a kind are personal information."""
    if rng.random() < 0.25:
        return _carrier(rng)
    if rng.random() < 0.12:  # one piece right after another
        a, z = address(rng, lang)
        second = rng.choice(([("address", a), ("", f", {z}")], [("email", email(rng))], [("phone", phone(rng))], [("name", name(rng))]))
        return [("", rng.choice(("", "to ", "von ", "à ", "para ", "cc: "))), ("name", name(rng)), ("", rng.choice((", ", " (", ", ", " / ", "\n"))), *second]
    r = rng.random()
    if r < 0.22:
        text = rng.choice(_NOTHING)
        for mark in ("{d1}", "{d2}", "{d3}", "{d4}", "{d6}", "{d7}"):
            while mark in text:
                text = text.replace(mark, _digits(rng, int(mark[2])), 1)
        while "{U}" in text:
            text = text.replace("{U}", _letters(rng, 1), 1)
        return [("", text.replace("{y}", str(rng.randint(1980, 2030))).replace("{W}", word(rng)))]
    if r < 0.5:
        title = rng.choice(_TITLES[lang]) if rng.random() < 0.5 else ""
        parts = _fill(rng.choice(_NAMES[lang]), {"n": lambda: [("name", name(rng))], "t": [("", title)]})
    elif r < 0.63:
        cue = rng.choice(_ID_WORDS[lang])
        parts = _fill(rng.choice(_ID_FRAMES[lang]), {"c": [("", cue if rng.random() < 0.6 else cue[0].upper() + cue[1:])], "i": [("id_number", id_number(rng))]})
    elif r < 0.76:
        parts = _fill(rng.choice(_PHONE_FRAMES[lang]), {"p": [("phone", phone(rng))]})
    elif r < 0.88:
        parts = _fill(rng.choice(_MAIL_FRAMES[lang]), {"e": [("email", email(rng))]})
    else:
        a, z = address(rng, lang)
        parts = _fill(rng.choice(_HOME_FRAMES[lang]), {"a": [("address", a)], "z": [("", z)]})
    if rng.random() < 0.35 and parts[0][0] == "" and parts[0][1]:
        head = parts[0][1]
        parts[0] = ("", head[0].upper() + head[1:] if rng.random() < 0.7 else head[0].lower() + head[1:])
    return parts


def refilled(rng: random.Random, text: str, marks: list[tuple[str, int, int]], lang: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The same text with every piece of information replaced by an invented one of its kind."""
    fresh = {"name": name, "email": email, "phone": phone, "id_number": id_number, "address": lambda r: address(r, lang)[0]}
    out, places, at = "", [], 0
    for kind, a, b in marks:
        piece = fresh[kind](rng)
        out += text[at:a]
        places.append((kind, len(out), len(out) + len(piece)))
        out += piece
        at = b
    return out + text[at:], places


def mixed(rng: random.Random, background: list[str], lang: str) -> tuple[str, list[tuple[str, int, int]]]:
    """A text of a few invented sentences, put between passages of a background text: (text, (kind, start, end))."""
    parts: list[Piece] = []
    for _ in range(rng.choice((1, 1, 2, 3))):
        if background and rng.random() < 0.75:
            cuts = rng.choice(background).split(". ")
            at = rng.randrange(len(cuts))
            parts.append(("", ". ".join(cuts[at : at + rng.choice((1, 1, 2))])[:220]))
            parts.append(("", rng.choice((". ", "; ", " – ", ", ", "\n", ". ", " (", " "))))
        parts += sentence(rng, lang)
        parts.append(("", rng.choice((". ", "! ", "; ", ", ", "\n", " – ", ") ", " "))))
    text, marks = "", []
    for kind, piece in parts:
        if kind:
            marks.append((kind, len(text), len(text) + len(piece)))
        text += piece
    return text.rstrip(), marks
