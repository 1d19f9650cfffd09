"""Written forms of personal information that leave no doubt: they label the bounded sample that the tagger learns from.

Nothing here takes part in a search: what is found, where it begins and ends and of what kind it is, the tagger says.
"""

from __future__ import annotations

import re

KINDS = ("name", "email", "phone", "id_number", "address")

# --- words that stand before or after; fixed values, in four languages ---
_PHONE_CUE = r"(?:tel|tél|telefon|teléfono|téléphone|telephone|phone|call|ring|rufnummer|mobil|mobile|móvil|portable|fax|handy|appele[rz](?: le)?|llam[ea](?: al)?|anrufen unter)"
_PHONE_TAIL = r"\((?:mobile|mobil|móvil|portable|handy|cell|home|privat)\)"
_ID_CUE = (
    r"(?:ssn|social security (?:number|no\.?)|national (?:id|insurance(?: no\.?| number)?)|(?:id|identity) (?:card|number|no\.?)|passport(?: no\.?| number)?"
    r"|driver(?:'s)? licen[cs]e(?: no\.?)?|driving licen[cs]e(?: no\.?)?|ausweisnummer|personalausweis(?:nummer| nr\.?)?|reisepass(?:nummer| nr\.?)?|steuer-?id|sv-nummer|sozialversicherungsnummer"
    r"|führerschein(?:nummer| nr\.?)?|dni|nie|nif|documento de identidad|pasaporte(?: n\.?\s?º| no?\.?)?|permiso de conducir(?: n\.?\s?º)?|n\.?\s?º de la seguridad social|seguridad social(?: n\.?\s?º)?"
    r"|passeport(?: n°| no\.?)?|carte d['’]identité(?: n°)?|n° de sécurité sociale|numéro de sécurité sociale|permis de conduire(?: n°)?)"
)
_NOT_CUE = r"(?:lot|batch|ref|réf|chembl|charge|lote|cas|doi|order|bestellung|pedido|commande)\.?[\s:]*$"
_TITLE = r"(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herrn?|Frau|Sr|Sra|Srta|Dra|Profa|Don|Doña|M|Mme|Mlle|Pr|Professeur|Docteur|Monsieur|Madame|Señora?|Doctora?|Professor)\.?\s+)"
_STREET = r"(?:Street|Str|St|Road|Rd|Lane|Ln|Avenue|Ave|Crescent|Cres|Close|Drive|Way|Court|Place|Square|Terrace|Row|Gardens|Hill)"

_HOST = r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._+'-]*[A-Za-z0-9])?"
EMAIL = [
    re.compile(rf"(?<![\w.+-])({_LOCAL})[ ]?@[ ]?({_HOST})(?![\w-])"),
    re.compile(rf"(?<![\w.+-])({_LOCAL})\s?[\[(]\s?(?:at|AT|At|arroba)\s?[\])]\s?((?:[A-Za-z0-9-]+(?:\.|\s?[\[(]\s?(?:dot|DOT|punto|point|punkt)\s?[\])]\s?))+[A-Za-z]{{2,}})(?![\w-])"),
    re.compile(r"(?<![\w.+-])((?:[A-Za-z0-9_+-]+ (?:dot|DOT) )*[A-Za-z0-9][A-Za-z0-9._+-]*) (?:at|AT) ((?:[A-Za-z0-9-]+ (?:dot|DOT) )+[A-Za-z]{2,})(?![\w-])"),
]
PHONE = re.compile(r"(?<![\w.,/+-])(?:\+\s?\d|\(?\d)[\d ()./-]{5,24}\d(?![\w%°]|[.,/-]\d)")
ID = re.compile(rf"(?i)(?<!\w){_ID_CUE}\s*[:#.]?\s*(?:n[°º.]\s*|nr\.?\s*|no\.?\s*)?(?-i:([A-Z0-9][A-Z0-9]*(?:[ .\-/][A-Z0-9]+)*))")
#: The shape of a social security number, wherever it stands.
ID_SHAPE = re.compile(r"(?<![\w.,/-])(\d{3}-\d{2}-\d{4})(?![\w/-])")
ADDRESS = [
    re.compile(rf"(?<![\w.,-])(\d{{1,4}} ?[A-Za-z]?,? (?:[A-Z][\w'’.-]+ ){{1,3}}{_STREET}\b(?:(?<=\bSt|\bRd|\bLn)\.|(?<=\bAve)\.|(?<=\bCres)\.)?)"),
    re.compile(r"(?<![\w.,-])(\d{1,4}(?: ?[A-Z](?!\w))?(?: (?:bis|ter|quater))?,? (?:rue|avenue|av\.|boulevard|bd\.?|place|chemin|impasse|allée|quai|cours|Rue|Avenue|Place)(?: (?:de la|de l['’]|de|du|des|d['’]))? ?[A-Z][\w'’-]+(?:[ -][A-Z][\w'’-]+)*)"),
    re.compile(r"(?<![\w-])([A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|Straße|Weg|Platz|-Straße|-Weg) \d{1,4} ?(?:[a-z](?!\w))?)"),
    re.compile(r"(?<![\w-])((?:Am|An der|An den|Im|Auf dem|Auf der|Zum|Zur|Unter den|Hinter der) [A-ZÄÖÜ][\w-]+ \d{1,4} ?(?:[a-z](?!\w))?)(?=,? \d{5}\b)"),
    re.compile(r"(?<![\w-])((?:Calle|C/|Avda\.|Avenida|Av\.|Paseo|P\.º|Plaza|Pza\.|Camino|Ronda|Carrera|calle|avenida|paseo|plaza)(?: (?:de la|de los|de las|de|del))? ?[A-ZÁÉÍÓÚ][\w'’-]+(?: [A-Z][\w'’-]+)*,? (?:n\.?\s?º ?|núm\. ?|nº ?)?\d{1,4} ?(?:[a-zA-Z](?!\w))?)"),
]
_FAMILY = r"(?:(?:von|van|de|da|di|del|der|den|zu|la|le|du|ter|mac|Von|Van|De) ){0,2}(?:[OD]['’]|Mc|Mac|Saint-|San-|Ben-)?[A-ZÀ-Þ][a-zß-ÿ]+(?:-[A-ZÀ-Þ][a-zß-ÿ]+)*"
_GIVEN = r"[A-ZÀ-Þ][a-zß-ÿ]+(?:-[A-ZÀ-Þ][a-zß-ÿ]+)?"
#: given name or initial, middle initials, family name; or family name first, with a comma
NAME = re.compile(rf"(?<![\w@'’.-])(?:{_FAMILY}, (?:{_GIVEN}(?: [A-Z]\.)?|[A-Z]\.(?: ?[A-Z]\.)*)|(?:{_GIVEN}|[A-Z]\.)(?: ?[A-Z]\.){{0,2}} ?{_FAMILY})(?![\w@])")
_TITLES = re.compile(_TITLE)
#: Capitalised words that open a greeting or a sentence, not a name; fixed values.
_NO_NAME = {"Liebe", "Lieber", "Grüße", "Dear", "Cher", "Chère", "Bonjour", "Cordialement", "Saludo", "Un", "Please", "Bitte", "Signed", "Author", "Auteur", "Autor", "Bearbeiter", "Contact", "Write", "Call", "Phone", "Tel", "Mail"}
# Where a person must stand: before the name, or after it.
_NAME_BEFORE = re.compile(
    rf"(?:\b(?:[Mm]y name is|[Dd]ear|[Ss]igned:|[Ss]igned by|[Aa]uthor:|[Aa]uteur ?:|[Aa]utore?:|[Aa]utora?:|[Bb]earbeiter(?:in)?:|[Vv]erfasser(?:in)?:|[Rr]eported by|[Aa]sk|[Cc]ontact|[Yy]ours,|[Rr]egards,|[Ss]incerely,"
    rf"|[Ii]ch heiße|[Mm]ein Name ist|[Ll]iebe Grüße,|[Gg]rüße,|[Gg]emeldet von|[Gg]ezeichnet:|[Ll]iebe[r]?|[Gg]eehrte[r]?|[Ff]ragen Sie|[Bb]itte"
    rf"|[Jj]e m['’]appelle|[Ss]igné ?:|[Ss]ignalé par|[Cc]her|[Cc]hère|[Dd]emande[rz] à|[Cc]ordialement,|[Bb]onjour"
    rf"|[Mm]e llamo|[Uu]n saludo,|[Cc]omunicado por|[Ff]irmado:|[Ee]stimad[oa]|[Qq]uerid[oa]|[Pp]regunt[ea](?:r)? a|[Aa]tentamente,)\s+{_TITLE}*|{_TITLE})$"
)
_DATE = re.compile(r"^(?:19|20)\d\d[-/.](?:0?\d|1[0-2])[-/.]\d{1,2}$")


def email_form(match: re.Match) -> str:
    """Plain local@host in lower case."""
    dots = lambda s: re.sub(r"\s", "", re.sub(r"\s?[\[(]\s?(?:dot|punto|point|punkt)\s?[\])]\s?| dot ", ".", s.lower()))
    return f"{dots(match[1])}@{dots(match[2])}"


def _emails(text: str):
    for p in EMAIL:
        for m in p.finditer(text):
            yield "email", m.start(), m.end(), email_form(m)


def _ids(text: str):
    for m in ID.finditer(text):
        value = m[1]
        # a following word in capitals may have been swept in: parts have digits, or are one letter before such a part
        parts = re.split(r"([ .\-/])", value)
        keep = 1
        for i in range(2, len(parts), 2):
            if not re.search(r"\d", parts[i]) and not (len(parts[i]) == 1 and (parts[i - 1] != " " or re.search(r"\d", "".join(parts[i + 2 : i + 3])))):
                break
            keep = i + 1
        parts = parts[:keep]
        value = "".join(parts)
        if sum(ch.isdigit() for ch in value) >= 5:
            yield "id_number", m.start(1), m.start(1) + len(value), re.sub(r"[^A-Z0-9]", "", value.upper())
    for m in ID_SHAPE.finditer(text):
        yield "id_number", m.start(1), m.end(1), re.sub(r"\D", "", m[1])


def _phones(text: str):
    for m in PHONE.finditer(text):
        s = m[0]
        if s.count("(") != s.count(")"):
            if s.startswith("(") or ")" in s:
                continue
            s = s[: s.index("(")].rstrip()
        digits = re.sub(r"\D", "", s)
        if not 7 <= len(digits) <= 15 or _DATE.match(s):
            continue
        before, after = text[max(0, m.start() - 24) : m.start()], text[m.start() + len(s) : m.start() + len(s) + 14]
        cued = re.search(rf"(?i)(?<!\w){_PHONE_CUE}\.?[:\s]*$", before) or re.match(rf"(?i)\s*{_PHONE_TAIL}", after)
        if not cued:
            if re.search(rf"(?i)(?<!\w){_NOT_CUE}", before) or not re.match(r"\+|00|\(0", s):
                continue
        yield "phone", m.start(), m.start() + len(s), digits


def _addresses(text: str):
    for p in ADDRESS:
        for m in p.finditer(text):
            yield "address", m.start(1), m.end(1), m[1].rstrip()


def name_candidates(text: str):
    """(start, end) of everything shaped like a name, titles left out; a longer reading may hide a shorter one."""
    at = 0
    while m := NAME.search(text, at):
        a, b = m.start(), m.end()
        t = _TITLES.match(text, a)
        if re.match(r"\w+", m[0])[0] in _NO_NAME:
            at = a + len(re.match(r"\w+", m[0])[0])
            continue
        if t and t.end() < b and NAME.match(text, t.end()):
            at = t.end()
            continue
        yield a, b
        at = m.start() + 1


def _names(text: str):
    for a, b in name_candidates(text):
        if _NAME_BEFORE.search(text[max(0, a - 40) : a]):
            yield "name", a, b, text[a:b]


def labelled(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, found) of every piece in a surrounding that leaves no doubt; the first reading wins."""
    found: list[tuple[str, int, int, str]] = []
    for source in (_emails, _ids, _addresses, _phones, _names):
        # what is found is blanked, so that a number beside another is not read as one with it
        body = text
        for _, a, b, _ in found:
            body = body[:a] + "\n" * (b - a) + body[b:]
        for kind, a, b, form in source(body):
            if all(b <= c or d <= a for _, c, d, _ in found):
                found.append((kind, a, b, form))
    return sorted(found, key=lambda x: x[1])


def learnt_names(texts: list[str]) -> tuple[set[str], set[str]]:
    """(given names, family names) of the names that the labels of some texts hold."""
    given, family = set(), set()
    for text in texts:
        for kind, a, b, _ in labelled(text):
            if kind == "name":
                first, last = split_name(text[a:b])
                given |= {first} if first[-1:] != "." else set()
                family.add(last)
    return given, family


def split_name(name: str) -> tuple[str, str]:
    """(given name or initial, family name) of a name in either order."""
    if "," in name:
        last, first = name.split(",", 1)
        return first.split()[0], last
    first, *rest = name.split()
    return first, " ".join(w for w in rest if not re.fullmatch(r"[A-Z]\.", w))


def with_learnt_names(text: str, given: set[str], family: set[str]) -> list[tuple[str, int, int, str]]:
    """``labelled``, and every further passage shaped like a name whose parts are names elsewhere in the sample."""
    found = labelled(text)
    for a, b in name_candidates(text):
        if all(b <= c or d <= a for _, c, d, _ in found):
            first, last = split_name(text[a:b])
            if last in family and (first in given or first[-1:] == "."):
                found.append(("name", a, b, text[a:b]))
    return sorted(found, key=lambda x: x[1])
