"""Personal information in sentences labelled by hand, of another make than the training sentences and the given texts."""

import numpy as np
import pytest

from affinis.llm import pii

# Sentences and what stands in them.
SENTENCES = [
    ("Her SSN is 123-45-6789.", [("id_number", "123456789")]),
    ("123-45-6789 is what I wrote as social security number", [("id_number", "123456789")]),
    ("Maria Keller filled in the form", [("name", "Maria Keller")]),
    ("The bus was late, so Tom Barrow walked home instead.", [("name", "Tom Barrow")]),
    ("After the meeting Priya Nandan sent everybody the slides.", [("name", "Priya Nandan")]),
    ("Nobody but Dr. Helen Ashworth may open the freezer.", [("name", "Helen Ashworth")]),
    ("Reach me under +44 20 7946 0991 or at kim.sand@oldmill.org.uk", [("phone", "442079460991"), ("email", "kim.sand@oldmill.org.uk")]),
    ("Our courier rang at 14 Ferncliff Avenue, Dunmore, and nobody opened.", [("address", "14 Ferncliff Avenue")]),
    ("Passport X4458129 expires in June.", [("id_number", "X4458129")]),
    ("The parcel for 7 Brook Lane, Alton 33218 came back.", [("address", "7 Brook Lane")]),
    ("If anything burns, dial (212) 555-0147 at once.", [("phone", "2125550147")]),
    ("Questions go to peter_k@example.net before noon.", [("email", "peter_k@example.net")]),
    ("You can write anna dot lee at site dot example dot org any time.", [("email", "anna.lee@site.example.org")]),
    ("We spoke to Mr J. Whitlock about the broken pump.", [("name", "J. Whitlock")]),
    ("Monsieur Alain Coudray habite 8 rue des Lilas, 75011 Paris.", [("name", "Alain Coudray"), ("address", "8 rue des Lilas")]),
    ("Le colis est parti chez Mme Odile Ferrand hier soir.", [("name", "Odile Ferrand")]),
    ("Pour toute question : 01 42 68 53 00 ou le site.", [("phone", "0142685300")]),
    ("Sa carte d'identité 880692310285 a été perdue.", [("id_number", "880692310285")]),
    ("Merci de répondre à luc.bernard@courriel.fr avant lundi.", [("email", "luc.bernard@courriel.fr")]),
    ("Nous livrons au 45, avenue Foch, 69006 Lyon.", [("address", "45, avenue Foch")]),
    ("Mi vecina Carmen Ortega vive en Calle Mayor 12, 28013 Madrid.", [("name", "Carmen Ortega"), ("address", "Calle Mayor 12")]),
    ("El paquete lo recogió Don Julio Santana por la tarde.", [("name", "Julio Santana")]),
    ("Su DNI 12345678Z no coincide con el registro.", [("id_number", "12345678Z")]),
    ("Si hay fuego, avise al 91 555 01 23 enseguida.", [("phone", "915550123")]),
    ("Mande la foto a rosa-gil@correo.es cuando pueda.", [("email", "rosa-gil@correo.es")]),
    ("La oficina está en Avenida de la Paz, 7, 46001 Valencia.", [("address", "Avenida de la Paz, 7")]),
    ("Meldung durch Sabine Krüger am Montag.", [("name", "Sabine Krüger")]),
    ("Gestern traf ich Uwe Lindemann beim Bäcker.", [("name", "Uwe Lindemann")]),
    ("Das Paket ging an die Gartenstraße 17, 80331 München.", [("address", "Gartenstraße 17")]),
    ("Seine Ausweisnummer L01X00T47 ist abgelaufen.", [("id_number", "L01X00T47")]),
    ("Bei Feuer sofort Tel. 089 1234567 wählen.", [("phone", "0891234567")]),
    ("Bitte an h.vogel@firma.de senden, danke.", [("email", "h.vogel@firma.de")]),
    ("Der Vertrag liegt bei Dr. Katrin Sommer im Büro.", [("name", "Katrin Sommer")]),
    ("The plates 33-55 gave 10.5 nM in Lot 7712-33-901.", []),
    ("Order 55-0192 was shipped on 2021-03-14 with 12 vials.", []),
    ("Der neue Roboter misst alle 15 Minuten bei 37 Grad.", []),
    ("Le tampon TRIS 50 mM reste stable à 4 degrés.", []),
    ("La muestra pesa 12,5 mg y mide 3 cm.", []),
    ("See Table 4 and Figure 2 of the Supplement for IC50 values.", []),
    ("CAS 50-78-2 and CHEMBL25 name the same compound.", []),
]


@pytest.fixture(scope="module")
def counted():
    texts = [t for t, _ in SENTENCES]
    got = [{(k, f) for k, _, _, f in pii.checked(t, s)} for t, s in zip(texts, pii.tag_texts(pii.load(), texts))]
    want = [set(w) for _, w in SENTENCES]
    return sum(map(len, want)), sum(map(len, got)), sum(len(a & b) for a, b in zip(want, got))


def test_recall_and_precision(counted):
    want, got, both = counted
    assert both >= 0.9 * want and both >= 0.9 * got, counted


def test_the_tagger_decides():
    """Without the tagger's word nothing comes out, and its kinds and borders are those of the result."""
    text = "Tom Barrow, tel. 089 1234567"
    assert pii.checked(text, []) == []
    assert pii.checked(text, [("name", 0, 10)]) == [("name", 0, 10, "Tom Barrow")]
    assert pii.checked(text, [("id_number", 17, 28)]) == [("id_number", 17, 28, "0891234567")]
    everything = [(k, 0, len(text)) for k in ("name",)]
    assert pii.checked(text, everything) == []  # no name holds digits


def test_windows_change_nothing(monkeypatch):
    """Wherever a piece stands, across the borders of windows too, the result is that of one window over the whole text."""
    weights = pii.load()
    filler = "The control series slows the smell of the mixture. "
    one = "Please write to Tom Barrow, 14 Ferncliff Avenue. "
    texts = [filler * n + one + filler * (9 - n) for n in range(10)] + [filler * n + "x" * (n % 7) + " Mail tom.barrow@oldmill.org.uk now. " + filler * 4 for n in range(10)]
    parts = [pii.checked(t, s) for t, s in zip(texts, pii.tag_texts(weights, texts))]
    monkeypatch.setattr(pii, "WINDOW", 4096)
    monkeypatch.setattr(pii, "STEP", 4000)
    assert parts == [pii.checked(t, s) for t, s in zip(texts, pii.tag_texts(weights, texts))]
    assert all(p[0][3] == "Tom Barrow" for p in parts[:10]) and all(p[0][3] == "tom.barrow@oldmill.org.uk" for p in parts[10:])
    assert pii.tag_texts(weights, ["", "a"]) == [[], []]


def test_windows_cover():
    for n in (1, 255, 256, 257, 448, 449, 1000):
        w = pii._windows(n)
        assert w[0][0] == 0 and w[-1][1] == n and all(b - a <= pii.WINDOW for a, b in w)
        assert all(c <= b for (_, b), (c, _) in zip(w, w[1:]))
    assert isinstance(pii._spans(np.array([0, 1, 2, 0, 3])), list)
