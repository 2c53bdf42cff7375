"""Trains the tagger of ``pii_model``: ``python -m pagemill.llm.pii_train FOLDER OUT [SECONDS [PROCESSES [SEED [WEIGHTS TO GO ON FROM]]]]``.

Labelled spans are made here. Personal items come from lists of common names of
many countries, from syllables, and from the number and address formats of
countries; they stand in sentences written for this purpose, in fields and rows,
or anywhere in a sentence of the background. The background is sentences of
blocks and attachments under FOLDER (at most ``BACKGROUND`` records, a documented
bound) that broad patterns do not suspect to hold an item. No item and no carrier
sentence is taken from the tables. A fifth of each list and of the
sentences is held out of training; recall and precision are printed for rows
made of that fifth alone. Each step makes new rows in ``PROCESSES`` processes, whose
gradients are averaged.
"""

from __future__ import annotations

import multiprocessing
import os
import re
import sys
import time
from collections import Counter

import numpy as np

from pagemill.llm.pii_model import LOOK_ALIKE, N_CLASSES, N_LABELS, NEG, TYPES, Tagger, backward_order, encode, lstm, spans

BACKGROUND = 25_000
NUMBERED = r"invoice|order|part|serial|version|build|ticket|batch|ledger|shipment|sample|page|room|section|table|figure|port|checksum|row|item|model|issue|chapter"
SUSPECT = re.compile(
    r"@|＠|\bat\b.{2,40}\bdot\b|[(\[]at[)\]]|\b(?:ssn|nino?|ni|passport|passeport|reisepass|ausweis|licen[cs]e|tax|social security|identity|national)\b.*\d|\b(?:phone|tel|fax|mobile|call|ring|t[eé]l[eé]fono?|telefon)\b.*\d"
    r"|\b(?:box|postfach|rue|calle|via|flat|apt)\b.*\d|(?:gasse|stra(?:ß|ss)e|weg|platz) \d|(?-i:\d+ [A-ZÀ-Þ]\w+ [A-ZÀ-Þ])",
    re.I,
)
DIGITS = re.compile(r"(?<![\d.-])[+(]?\d(?:[ ().\-/]{0,2}\d){6,}")
PAIR = re.compile(r"\b(?!(?:Der|Die|Das|Den|Dem|Des|Ein|Eine|Einen|Einem|Im|Am|Vom|Zum|Zur)\b)([A-ZÀ-ÞΑ-ΩА-Я][\w'’-]*),?\s+([A-ZÀ-ÞΑ-ΩА-Я][\w'’-]*)")
END = re.compile(r"(?<=[a-zß-ÿ0-9)\]\"'`][.!?])(?<!\b(?:Mr|Ms|Dr|Sr|St)\.)(?<!\b(?:Mrs|Sra|Mme)\.)(?<!\bProf\.)\s+|\n+")
TITLED = re.compile(r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herrn?|Frau|Mme|Mlle|M|Sr|Sra|Dear|Attn|Regards|Signed|by|von|para|por)\b[.,:]*\s+[A-ZÀ-Þ]")

# Common given names and surnames of many countries, in no order of importance (fixed values).
GIVEN = (
    "James Robert Linda Susan Jessica Karen Siobhan Niamh Declan Aoife Callum Fiona Hamish Gareth Rhys Megan Brandon Tyler Ashley Kayla Jamal Keisha Wolfgang Jürgen Heike Sabine Uwe Katrin Detlef Anke Joost Maarten Femke Sanne Bram Lotte Lars Sven Astrid Sigrid Bjørn Freja Åsa Matti Päivi Aino Jukka"
    " Pierre Antoine Camille Élodie Mathieu Margaux Benoît Solène Giovanni Chiara Matteo Francesca Luca Alessia Javier Pilar Alejandro Lucía Íñigo Rocío João Beatriz Tiago Inês Thiago Larissa Andrzej Małgorzata Krzysztof Zofia Jakub Kateřina Zdeněk Lenka Dragan Jelena Zoran Milica Ivo Snežana Sergei Natalia Vladimir Tatiana Oleksandr Oksana"
    " Ion Mihaela Gheorghe Gábor Zsófia István Nikos Eleni Giorgos Despina Mehmet Ayşe Emre Elif Omar Fatima Khalid Samira Tariq Noor Avi Yael Moshe Tamar Reza Shirin Arjun Deepika Rajesh Lakshmi Sanjay Anjali Imran Zainab Hiroshi Yuki Takashi Sakura Haruto Min-jun Seo-yeon Ji-woo Wei Xiu Jian Mei Nguyet Linh Tuan Chidi Ngozi Oluwaseun Amara Kwame Abena Thabo Naledi"
).split()
SURNAME = (
    "Smith Johnson Williams Jones Taylor Murphy O'Brien O'Connor McCarthy MacDonald Campbell Evans Hughes Robinson Walker Thompson Washington Jefferson Müller Schmidt Schneider Fischer Weber Becker Hoffmann Schäfer Koch Bauer Jansen Bakker Visser Dekker Mulder Hansen Olsen Larsen Nilsson Lindqvist Bergström Korhonen Virtanen Nieminen Dubois Lefèvre Moreau Girard Roux Fontaine Mercier"
    " Rossi Ferrari Esposito Bianchi Romano Ricci García Fernández López Martínez Sánchez Ortega Silva Santos Oliveira Pereira Carvalho Kowalski Nowak Wiśniewski Zieliński Novák Svoboda Dvořák Horvat Kovačević Petrović Jovanović Ivanov Smirnov Kuznetsov Popova Shevchenko Kovalenko Popescu Ionescu Nagy Tóth Szabó Papadopoulos Georgiou Nikolaidis Yılmaz Demir Öztürk Haddad Mansour Khalil Rahman Aziz Cohen Levi Mizrahi"
    " Ahmadi Sharma Patel Singh Gupta Reddy Iyer Khan Hussain Tanaka Suzuki Watanabe Nakamura Kobayashi Kim Park Choi Zhang Wang Liu Chen Huang Nguyen Pham Okafor Adeyemi Mensah Nkosi Dlamini Abubakar Peterson Reyes Mendoza Vargas Castillo"
).split()
PARTICLE = ["van", "van der", "van den", "de", "de la", "del", "von", "zu", "da", "dos", "di", "della", "du", "le", "bin", "al", "ter"]
TITLES = ["Mr", "Mr.", "Mrs", "Mrs.", "Ms", "Ms.", "Miss", "Dr", "Dr.", "Prof.", "Herr", "Herrn", "Frau", "Mme", "M.", "Mlle", "Sr.", "Sra.", "Sig.", "Dhr.", "Mevr."]
STREET = "Oak Maple Elm Cedar Pine Walnut Willow Chestnut High Main King Queen Victoria Albert Church School Bridge London York Union Franklin Lincoln Madison Monroe Highland Prospect Spring Summit Ridge Valley Meadow Sunset Lakeview Riverside Broad Market Water Castle Abbey Priory Grange Manor North South".split()
ROAD = "Street St St. Avenue Ave Ave. Road Rd Rd. Lane Ln. Drive Dr. Boulevard Blvd Court Ct. Place Pl. Terrace Way Close Crescent Square Row Hill Gardens Parkway Highway".split()
ROADS = {
    "de": "Goethestraße Schillerstr. Bahnhofstraße Ringstraße Schlossallee Marktplatz Kirchweg Feldweg Rosengasse Dorfstr. Lessingstraße Burggasse Uferweg Kaiserplatz Wiesenweg".split(),
    "fr": "rue Victor Hugo|rue de la République|avenue Jean Jaurès|boulevard Voltaire|place Bellecour|rue des Lilas|allée des Roses|impasse du Lavoir|rue Pasteur|chemin des Vignes|quai de Seine".split("|"),
    "es": "Calle Alcalá|Avenida Diagonal|Calle de Serrano|Plaza España|C/ Goya|Paseo de Gracia|Calle San Juan|Avenida del Mar|Calle Real".split("|"),
    "it": "Via Roma|Via Garibaldi|Corso Vittorio Emanuele|Piazza Dante|Viale Europa|Via Mazzini|Via dei Mille".split("|"),
    "nl": "Kerkstraat Dorpsstraat Prinsengracht Stationsweg Molenlaan Beatrixplein Julianalaan".split(),
}
PLACE = "Springfield Riverton Manchester Bristol Leeds Glasgow Cardiff Dublin Cork Boston Chicago Denver Austin Seattle Toronto Sydney Berlin Hamburg München Köln Leipzig Bremen Paris Lyon Toulouse Nantes Lille Madrid Valencia Sevilla Bilbao Milano Torino Bologna Utrecht Rotterdam Antwerpen Gent Wien Graz Praha Kraków Lisboa Porto Oslo Bergen Aarhus Malmö Helsinki".split()
BOX = ["P.O. Box", "PO Box", "P. O. Box", "Post Office Box", "Postfach", "B.P.", "Apartado", "Casella postale", "Postbus"]
TLD = "com com com org net io de fr es it nl eu co.uk ac.uk edu gov info biz dev app ch at be pl cz se no dk fi ie ca com.au co.jp in com.br local test invalid example".split()
LABEL = (
    "SSN|SSN:|social security number|Social Security No.|soc. sec. no.|passport|Passport:|passport no.|passport number|Reisepass Nr.|Reisepass|passeport n°|pasaporte|driver's license|driver's licence no.|driving licence|driving license number|Führerschein Nr.|permis de conduire"
    "|tax ID|tax ID:|tax number|taxpayer number|tax identification number|Steuer-ID|Steuernummer|NIF|numéro fiscal|codice fiscale|TIN|national ID|national identity number|national insurance number|NI number|NINO|NINO:|NI no.|identity card|identity card no.|ID card|ID card no.|identity number|carte d'identité|DNI|NIE|Personalausweis|Personalausweis-Nr.|Ausweisnummer|BSN|PESEL|CPF|Aadhaar|personal number|personal ID|sécurité sociale"
).split("|")

# Sentences that carry an item, by type; a form feed stands for the item (fixed values).
CARRIERS = {
    "name": "Please call \f tomorrow.|I spoke with \f about the plan.|\f will join us next week.|Many thanks to \f for the help.|Hello \f,|Hi \f,|Dear \f,|Dear \f:|Sincerely,\n\f|Best wishes,\n\f|Warm regards,\n\f|Cheers,\r\n\f|Mit freundlichen Grüßen\n\f|Cordialement,\n\f|Un saludo,\n\f|Yours faithfully,\n\f|Name: \f|Full name: \f|Patient: \f|Customer: \f|Employee: \f|Applicant: \f|Owner: \f|Nombre: \f|Nom : \f"
    "|Sehr geehrte \f,|Written by \f|Photo by \f|cc: \f|Assigned to \f on the board.|The letter from \f arrived late.|We hired \f in spring.|\f lives near the river.|\f said that the work was done.|\f and her brother left early.|Did \f sign it?|Ask \f, not me.|The witness, \f, was heard.|El señor \f vino ayer.|Je remercie \f de sa visite.|Ansprechpartner: \f|Signature: \f|Witnessed by \f|Interview with \f|Sender: \f|To: \f|Recipient: \f|Guest: \f|\f (manager)|\f, chairman|\f wrote:|On Monday \f replied.|This was checked by \f again.|Attention: \f|For the attention of \f"
    "|Kontakt: \f|Contact: \f|Please ask for \f at the door.|As \f noted, nothing was lost.|Unterzeichnet von \f|Firmado por \f|Signé : \f|Approved by \f|Chair: \f|Minutes taken by \f|Nothing was heard from \f since.|Greetings, \f|Thank you, \f",
    "email": "Drop a line to \f today.|Send it to \f please.|My address is \f now.|Email: \f|email \f|Mail: \f|Contact: \f|contact us at \f|You can reach me under \f.|Reply to \f by Friday.|Correo: \f|Courriel : \f|E-Mail-Adresse: \f|<\f>|(\f)|To: \f|Cc: \f|Bcc: \f|Forward everything to \f.|Bei Fragen: \f|Account \f was made.|User \f logged in.|The message came from \f.|Subscribe with \f|Any questions? \f|Support: \f|an \f schicken|envoyez à \f|escriba a \f|Login: \f|\f bounced.|Ask \f for the files.|Sender: \f;|I mailed \f yesterday.",
    "phone": "My number is \f.|Call me on \f.|call \f|Phone: \f|Ph. \f|Tel: \f|Tel.: \f|tel. \f|Telephone \f|Mobile \f|Cell: \f|Fax \f|Handy: \f|Telefon: \f|Téléphone : \f|Teléfono \f|Rufen Sie \f an.|You may dial \f at night.|Text \f to confirm.|The hotline \f is free.|Reach us at \f.|Office: \f|Home: \f|Work: \f|WhatsApp: \f|Contact number: \f|Our line is \f since June.|Ring \f and wait.|Appelez le \f.|Llame al \f|or phone \f between nine and ten|(\f)|Emergency: \f|Direct line \f|Hours are nine to five on \f.|Try \f first.",
    "id_number": "My \f was stolen.|The \f is missing.|\f|Check \f again.|\f belongs to the guest.|He showed his \f at the gate.|(\f)|\f, valid until June|Her \f does not match.|Documents: \f|Remove \f from the file.|Please enter \f here.|Seen: \f|We hold \f for this person.|Proof: \f; issued abroad.|Mask \f before sharing.|the owner of \f|Black out \f.|\f was given by phone.|The form shows \f.|Copy: \f|whose \f is on the list",
    "address": "I live at \f.|Send the parcel to \f.|Postal address: \f|Adresse: \f|Dirección: \f|Indirizzo: \f|Home address: \f|Billing address: \f|Mailing address:\n\f|Our office is at \f.|She moved to \f last year.|Visit us: \f|Wohnhaft: \f|domicilié au \f|vive en \f|The house at \f was sold.|Deliver to:\n\f|Ship to: \f|From: \f|We meet at \f at noon.|The flat, \f, is empty.|\f|Registered at \f since May.|Residence: \f|Pick up at \f today.|Please post it to \f.|Location: \f|Mail goes to \f now.|Her new home is \f.|The keys are kept at \f by a friend.|Invoices for \f are paid.|The lease of \f ended.",
}
ORGANISATION = "Ltd Ltd. GmbH AG Inc Inc. LLC Corp. Company Group Holdings Partners Bank Insurance Institute Foundation Museum Library University College School Hospital Clinic Press Publishing Archive Society Association Council Committee Department Office Agency Laboratory Works Industries Systems Software Hotel Café Theatre".split()
#: Sentences that look as if they had an item but have none; fields in braces are filled in.
PLAIN = (
    "{Label} {d3}-{d2}-{d4} is ready.|{label} no. {d3} {d3} {d4}|{label} {CC}{d6}|{label} {CC}-{d5} was closed.|{label} number {d9} stays.|{label} {d4} {d4} {d4} {d4}|The {label} {d2} {d2} {d2} is stored.|{Label}: {CC}{CC}{d7}|{CC}{CC}-{d5}|See {label} {d4}-{d2}-{d4}.|{label} {d2} {d3} {d3} {d3} is on the shelf.|20{d2}-0{d1}-1{d1}|1{d1}.0{d1}.20{d2}|1{d1}/0{d1}/20{d2}|1{d1}:{d2}:{d2}|{d3}.{d2}.{d1}.{d2}|v{d1}.{d2}.{d1}|{d3},{d3}.{d2}|{d1}.{d4}|{d3} x {d3} x {d2}|({d3}, {d3}, {d3}, {d2})|{d3}.0, {d3}.5, {d2}.0"
    "|{X} {Org}|{X} {Y} {Org} sent it.|{X} & {Y} {Org}|{X} & Sons|Project {X}|Project {X} {Y} began.|Operation {X}|The {X} {Y} was sold.|the {X} Report|{X} Street was closed.|{Street} {Road} is quiet.|Near {Place}.|The road to {Place} is long.|{Place} and {Place}|In {Place} and {Place}, nothing changed.|{Place} {Org}|Room {d3}, {Place}|the river at {Place}|{d2} trains to {Place} left.|{d3} people of {Place} came.|Flight {CC}{CC}{d3} to {Place}|{Place}, {d2} May|{Place} {d1}.{d2}"
    "|Dear colleagues,|Dear customer,|Dear Sir or Madam,|Dear Sir or Madam|Dear Sir,|To whom it may concern|Dear team,|Hello everyone,|Hi all,|Regards, the {w} team|Sincerely,\nthe {w} office|Sender: {w} desk|Signature: missing|Name: {w}|Contact: the {w} office|Contact the {w}.|Please call the {w} office.|Approved by the {w} board|Written by the {w}|Email: none|Phone: none given|Address: unknown|The email of the {w} bounced.|call the {w} at noon|Prepared for {X} {Org}|Thanks to the {w} {w}|Mr and Mrs are titles.|Patient: {w}|To: all {w}s|From: the {w} list|Owner: {w} {w}|Assigned to the {w} team"
    "|{W} {W}|{W} {W} {W}|{W} And {W}|The {W} {W}|{W} Of The {W}|{d1}. {W} {W}|{W} {d1}\t{W}\t{W}|{W}: {W} {W}|{W}, {W} and {W}|{w}, {w}; {w} {w}|{W}; {W}|{w}.{w}()|@{w}|@{w} {d2}|#{d4}|{w}@{d1}x|{w} @ {d2}|at {w} dot|{w}_{w} = {d3}|`{w}-{w}`|--{w} {d3}|{w}/{w}.txt|http://{w}.{w}.com/{w}|https://{w}.org|{w}.{w}.net|{hex}|{b64}|{U} {U}|{U} {w} {U}|{U}: {d3}|{W}, the {w} {w} the {w}.|{W}, a {w} and a {w}.|{W}, {d3} {w}s.|Ask {X} about it.|{X} says so.|{Given} Street|Saint {Given} Church|{Given} {Org}|Hurricane {Given}|Chapter {d1} {W} {W}|Fig. {d1} {W} {w}"
    "|Monday, {d1} May|Tuesday and Wednesday|January February March|North America|South Korea|New Year|User Guide|Table of Contents|Open Source|Machine Learning|Terms and Conditions|{Org} of {W}|{Org} for {W} and {W}|{W} {Org}|{X} model {d3}|the {X} method|{X} {X} theorem"
).split("|")
KINDS = "invoice order part serial version build ticket batch ledger shipment sample case file shelf asset model item room section lot record reference contract product account".split()


def part(items: list, held: bool) -> list:
    """Every fifth of a list is held out."""
    return [x for k, x in enumerate(items) if (k % 5 == 2) == held]


class Maker:
    """Rows of text and labels. ``held`` makes them of the held-out parts alone."""

    def __init__(self, seed: int, background: list[str], held: bool = False):
        self.r = np.random.default_rng(seed)
        self.background = part(background, held)
        self.words = sorted({w for s in background[:4000] for w in re.findall(r"[a-z]{4,12}", s)})
        cut = lambda items: part(items, held)
        self.given, self.surnames, self.places, self.streets, self.tlds = cut(GIVEN), cut(SURNAME), cut(PLACE), cut(STREET), cut(TLD)
        self.roads = {k: cut(v) for k, v in ROADS.items()}
        self.carriers = {k: cut(v.split("|")) for k, v in CARRIERS.items()}
        self.plain = cut(PLAIN)

    def pick(self, items):
        return items[self.r.integers(len(items))]

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def digits(self, n: int) -> str:
        return "".join(map(str, self.r.integers(0, 10, n)))

    def upper(self, n: int) -> str:
        return "".join(self.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))

    def syllables(self, least: int, most: int) -> str:
        """An invented word that can be spoken."""
        s = ""
        for _ in range(self.r.integers(least, most + 1)):
            s += self.pick("b br c ch cl d dr f fl fr g gl gr h j k kl kr l m n p pr qu r s sch sh sk sl sp st str sv t th tr v w y z zh".split() + [""] * 3)
            s += self.pick("a e i o u a e i o ä ö ü é á ó í å ø ai au ea ee ei ie oa oo ou".split()[: 9 if self.chance(0.75) else None]) + self.pick("l ll m n nd ng nk r rd rk rn rr rt s sk ss st t tt ck x p ff z".split() + [""] * 20)
        return s

    def capital(self, s: str) -> str:
        return s[:1].upper() + s[1:]

    def surname(self) -> str:
        form = self.r.random()
        if form < 0.4:
            s = self.pick(self.surnames)
        elif form < 0.7:  # a stem with what surnames of many languages end in
            s = self.capital(self.syllables(1, 2)) + self.pick("son sen sson ssen man mann ton ham field wood well worth ford ley land burg berg stein bach meyer stra ema inga sma ski ska cki wicz czyk ov ova ev eva enko chuk yuk ić vić escu eanu ini etti ucci elli one ez es eira inho eau ier ard et oğlu opoulos idis akis nen ainen kainen as aitis ánszky ssian yan vili dze".split())
        else:
            s = self.capital(self.syllables(2, 3))
        if self.chance(0.04):
            s = self.pick(["Mc", "Mac", "O'", "O’", "D'", "Fitz", "St. ", "Le "]) + s
        return s

    def first(self) -> str:
        s = self.pick(self.given) if self.chance(0.7) else self.capital(self.syllables(1, 3)) + self.pick(["", "a", "o", "ie", "us", "na", "el", "en", "is"])
        return s + self.pick([" ", "-"]) + self.pick(self.given) if self.chance(0.04) else s

    def name(self, alone: bool = False) -> str:
        first, last, initial = self.first(), self.surname(), self.pick("ABCDEFGHIJKLMNOPRSTUVWYZ")
        if self.chance(0.1):
            last = self.pick([f"{last}-{self.surname()}", f"{last} {self.surname()}", f"{self.pick(PARTICLE)} {last}", f"{self.pick(PARTICLE)} {last}"])
        forms = [f"{first} {last}"] * 6 + [f"{initial}. {last}", f"{first} {initial}. {last}", f"{last}, {first}", f"{first} {self.first()} {last}"]
        if not alone:
            forms += [f"{initial}. {last}", f"{self.pick(TITLES)} {last}", f"{self.pick(TITLES)} {last}", f"{self.pick(TITLES)} {first} {last}", f"{initial}. {self.upper(1)}. {last}"]
        s = self.pick(forms)
        form = self.r.random()
        if form < 0.06:
            return s.upper()
        if form < 0.1 and not alone:
            return f"{first} {last}".lower()
        if form < 0.115:  # letters of other scripts
            low, high, size = self.pick([(0x4E00, 0x9FA0, 3), (0xAC00, 0xD7A0, 3), (0x3041, 0x3096, 5), (0x0627, 0x064A, 5), (0x05D0, 0x05EA, 5)])
            word = lambda n: "".join(chr(c) for c in self.r.integers(low, high, n))
            return word(size) if size == 3 else f"{word(size)} {word(size)}"
        if form < 0.135:
            low, high = self.pick([(0x0430, 0x0450), (0x03B1, 0x03CA)])
            word = lambda: "".join(chr(c) for c in self.r.integers(low, high, self.r.integers(4, 9))).capitalize()
            return f"{word()} {word()}"
        return s

    def domain(self) -> str:
        word = lambda: self.pick(self.words) if self.chance(0.5) else self.syllables(1, 3)
        host = self.pick([word(), word(), f"{word()}-{word()}", f"{word()}{word()}", f"{self.pick(['mail', 'smtp', 'post', 'eu', 'web'])}.{word()}", f"{word()}{self.digits(2)}"])
        return f"{host}.{self.pick(self.tlds) if self.chance(0.9) else self.syllables(1, 2)}"

    def email(self) -> str:
        plain = lambda s: re.sub(r"[^a-z0-9]", "", s.lower()) or "x"
        first, last, word = plain(self.first()), plain(self.surname()), self.pick(self.words)
        user = self.pick([f"{first}.{last}", f"{first}{self.pick(['', '_', '-'])}{last}", first[0] + last, f"{first[0]}.{last}", last, first, f"{last}{self.digits(2)}", f"{first}{self.digits(self.r.integers(1, 5))}", f"{last}.{first}", f"{first}+{word}", f"{word}-{self.pick(self.words)}", f"{word}.{self.digits(2)}", word, self.pick(["info", "support", "sales", "office", "admin", "hello", "contact", "billing", "noreply", "team"]), f"{word}_{self.digits(3)}", self.syllables(2, 3)])
        host, form = self.domain(), self.r.random()
        dotted = lambda sep: host.replace(".", sep)
        if form < 0.7:
            s = f"{user}@{host}"
        elif form < 0.76:
            s = f"{user} [at] {self.pick([host, dotted(' [dot] '), dotted('[dot]')])}"
        elif form < 0.84:
            s = f"{user}{self.pick(['(at)', ' (at) '])}{self.pick([host, dotted('(dot)'), dotted(' (dot) ')])}"
        elif form < 0.94:
            s = f"{user} at {dotted(' dot ')}"
        else:
            s = self.pick([f"{user} @ {host}", f"{user}＠{host}", f"{user}@ {host}"])
        return s.upper() if self.chance(0.08) else s

    def phone(self) -> str:
        d, sep = self.digits, self.pick([" ", " ", "-", ".", "/", "  "])
        country = str(self.pick([1, 1, 7, 20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, 52, 55, 61, 81, 82, 86, 90, 91, 351, 353, 358, 420]))
        area = str(self.r.integers(200, 990))
        groups = [d(self.r.integers(2, 5)) for _ in range(self.r.integers(2, 5))]
        while sum(map(len, groups)) < 6:
            groups.append(d(2))
        s = self.pick([
            f"({area}) {d(3)}-{d(4)}", f"{area}{sep}{d(3)}{sep}{d(4)}", f"{area}-{d(3)}-{d(4)}", f"+1{sep}{area}{sep}{d(3)}{sep}{d(4)}", f"1-{area}-{d(3)}-{d(4)}", f"+{country}{sep}{sep.join(groups)}", f"+{country} {' '.join(groups)}", f"00{country}{sep}{sep.join(groups)}", f"0{d(2)}{sep}{sep.join(groups)}", f"0{d(3)}{sep}{d(3)}{sep}{d(4)}",
            f"(0{d(self.r.integers(2, 5))}) {' '.join(groups)}", f"+{country} (0){d(2)} {' '.join(groups)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+{country}{d(9)}", f"0{d(9)}", f"tel:+{country}{d(9)}", f"0{d(4)} {d(6)}", f"0{d(2)}/{d(7)}", f"({area}){d(3)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}",
        ])
        return s + f"{self.pick([' ext.', ' ext', ' x', ', ext.', ' extension', ' Durchwahl'])} {d(self.r.integers(2, 5))}" if self.chance(0.1) else s

    def id_number(self) -> tuple[str, int]:
        """A label with its number, and where the number starts."""
        d, up, label = self.digits, self.upper, self.pick(LABEL)
        tail = [d(self.r.integers(2, 5)) for _ in range(self.r.integers(2, 5))]
        number = self.pick([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{up(2)} {d(2)} {d(2)} {d(2)} {up(1)}", f"{up(2)}{d(6)}{up(1)}", f"{up(2)}{d(7)}", f"{up(1)}{d(7)}", f"{up(1)}{d(8)}", d(9), d(11), f"{up(5)}{d(6)}{up(2)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{up(1)}{d(2)}{d(6)}", f"{d(6)}-{d(4)}", f"{d(8)}{up(1)}", f"{up(1)}{d(7)}{up(1)}", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", f"{d(4)} {d(4)} {d(4)}", f"{up(6)}{d(2)}{up(1)}{d(2)}{up(1)}{d(3)}{up(1)}", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)}", self.pick([" ", "-", "/"]).join([*tail, d(3)])])
        middle = self.pick([" "] * 8 + [": ", " is ", " = ", " # ", " no. ", " of "])
        return f"{label}{middle}{number}", len(label) + len(middle)

    def place(self) -> str:
        form = self.r.random()
        s = self.pick(self.places) if form < 0.35 else self.capital(self.syllables(1, 2)) + self.pick("ton ham ville burg heim stadt dorf ford field bridge port mouth by thorpe stead hurst minster grad ów ice bourg court ac ano ello elo ó ës heide kirchen bury".split()) if form < 0.8 else self.capital(self.syllables(2, 3))
        return self.pick(["New ", "St. ", "Bad ", "Upper ", "San ", "Saint-"]) + s if self.chance(0.06) else s

    def street(self) -> str:
        form = self.r.random()
        word = self.pick(self.streets) if form < 0.4 else self.surname() if form < 0.6 else self.capital(self.pick(self.words)) if form < 0.8 else self.capital(self.syllables(2, 3))
        return f"{self.pick(['North ', 'N. ', 'West ', 'Old ', 'E. ']) if self.chance(0.1) else ''}{word} {self.pick(ROAD)}"

    def postcode(self) -> str:
        d = self.digits
        return self.pick([d(5), d(5), d(4), f"{self.upper(2)}{d(1)} {d(1)}{self.upper(2)}", f"{self.upper(1)}{d(2)} {d(1)}{self.upper(2)}", f"{self.upper(2)} {d(5)}", f"{d(4)} {self.upper(2)}", f"{d(3)} {d(2)}", f"{self.upper(2)} {d(5)}-{d(4)}"])

    def address(self) -> str:
        n, place, code, sep = str(self.r.integers(1, 999)), self.place(), self.postcode(), self.pick([", ", ", ", ", ", "\n", " "])
        n = f"{n}{self.pick('abcABC')}" if self.chance(0.1) else n
        home = self.pick(["Flat", "Apt", "Apt.", "Unit", "Suite", "Apartment"]) + f" {self.r.integers(1, 60)}{self.pick(['', '', 'A', 'B'])}"
        road = f"{n} {self.street()}"
        de = self.pick(self.roads["de"]) if self.chance(0.4) else self.capital(self.syllables(1, 3)) + self.pick(["straße", "str.", "strasse", "weg", "gasse", "allee", "platz", "ring", "damm"])
        fr = self.pick(self.roads["fr"]) if self.chance(0.4) else f"{self.pick(['rue', 'avenue', 'chemin', 'place'])} {self.pick(['', 'de la ', 'du ', 'des '])}{self.capital(self.syllables(1, 3))}"
        es = self.pick(self.roads["es"]) if self.chance(0.4) else f"{self.pick(['Calle', 'Avenida', 'Plaza', 'Camino'])} {self.pick(['', 'de la ', 'del '])}{self.capital(self.syllables(1, 3))}"
        return self.pick([
            f"{road}{sep}{place}", f"{road}{sep}{place}", f"{road}{sep}{place} {code}", f"{road}{sep}{place}, {code}", f"{home}, {road}{sep}{place}", f"{home}, {road}{sep}{place} {code}", f"{road}, {home}{sep}{place}, {code}", f"{self.pick(BOX)} {self.digits(self.r.integers(2, 6))}{sep}{place}", f"{self.pick(BOX)} {self.digits(self.r.integers(2, 6))}, {code} {place}",
            f"{de} {n}{sep}{code} {place}", f"{de} {n}, {place}", f"{n} {fr}{sep}{code} {place}", f"{n}, {fr}, {place}", f"{es} {n}{sep}{code} {place}", f"{es}, {n}, {place}", f"{self.pick(self.roads['it'])} {n}{sep}{code} {place}", f"{self.pick(self.roads['nl'])} {n}{sep}{code} {place}",
        ])

    def fill(self, frame: str) -> str:
        word = lambda: self.pick(self.words)
        proper = lambda: self.pick([self.capital(self.syllables(2, 3)), self.capital(word()), self.surname(), self.place()])
        made = {
            "label": lambda: self.pick(KINDS), "Label": lambda: self.capital(self.pick(KINDS)), "w": word, "W": lambda: self.capital(word()), "U": lambda: word().upper(), "CC": lambda: self.upper(1), "X": proper, "Y": proper, "Org": lambda: self.pick(ORGANISATION), "Place": self.place, "Street": lambda: self.pick(self.streets),
            "Road": lambda: self.pick(ROAD), "Given": lambda: self.pick(self.given), "hex": lambda: "".join(self.pick("0123456789abcdef") for _ in range(16)), "b64": lambda: "".join(self.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(90)),
        }
        return re.sub(r"\{(\w+)\}", lambda m: made[m[1]]() if m[1] in made else self.digits(int(m[1][1:])), frame)

    def item(self, alone: bool) -> tuple[str, int, int]:
        """An item with its label where it has one, where the item itself starts, and its type."""
        kind = int(self.r.choice(len(TYPES), p=[0.18, 0.17, 0.31, 0.16, 0.18]))
        if TYPES[kind] == "name":
            return self.name(alone), 0, kind
        if TYPES[kind] == "id_number":
            return *self.id_number(), kind
        return getattr(self, TYPES[kind])(), 0, kind

    def carried(self) -> tuple[str, list[tuple[int, int, int]]]:
        """A text with the (start, end, type) of the item in it."""
        form = self.r.random()
        value, skip, kind = self.item(form > 0.8)
        if form < 0.55:
            frame = self.pick(self.carriers[TYPES[kind]])
        elif form < 0.8:  # anywhere in a sentence of the background
            s = self.pick(self.background)[:160]
            gaps = [m.start() for m in re.finditer(" ", s)] or [len(s)]
            at = self.pick(gaps)
            frame = s[:at] + self.pick([" ", " ", " ", ", ", ": ", " ("]) + "\f" + self.pick(["", "", ",", "."]) + s[at:]
        elif form < 0.9:
            frame = self.pick(["\f", "\f\n", "- \f", "\f.", "\f;"])
        else:
            row = [self.fill(self.pick(["{w}", "{W}", "{d4}", "{CC}{d3}", "{w} {w}", "20{d2}-0{d1}-1{d1}"])) for _ in range(self.r.integers(1, 4))]
            row.insert(self.r.integers(len(row) + 1), "\f")
            frame = self.pick(["\t", ",", "; ", " | "]).join(row)
        at = frame.index("\f")
        return frame.replace("\f", value, 1).replace("\f", ""), [(at + skip, at + len(value), kind)]

    def shout(self, s: str) -> str:
        """Some words in capitals, as in headings and alarms."""
        return re.sub(r"[a-z]{3,}", lambda m: m[0].upper() if self.chance(0.2) else m[0], s) if self.chance(0.15) else s

    def header(self) -> tuple[str, list[tuple[int, int, int]]]:
        """A mail's sender: a name and an address between angle brackets."""
        name, mail = self.name(True), self.email()
        start = self.pick(["From: ", "To: ", "Cc: ", "\ufeffFrom: ", "Von: ", "De : ", "", "Reply-To: "])
        text = f"{start}{name} <{mail}>"
        return text, [(len(start), len(start) + len(name), 2), (len(text) - 1 - len(mail), len(text) - 1, 0)]

    def row(self) -> tuple[str, np.ndarray]:
        """A text and the label of each character."""
        parts: list[tuple[str, list]] = []
        for _ in range(self.r.integers(1, 5)):
            form = self.r.random()
            if form < 0.36:
                parts.append((self.shout(self.pick(self.background)), []))
            elif form < 0.58:
                parts.append((self.fill(self.pick(self.plain)), []))
            elif form < 0.63:
                parts.append(self.header())
            else:
                parts.append(self.carried())
        text, labels = "", []
        for s, items in parts:
            if text:
                gap = self.pick([" "] * 7 + ["\n", "\n\n", "\r\n", ". "])
                text, labels = text + gap, labels + [0] * len(gap)
            own = [0] * len(s)
            for a, b, kind in items:
                own[a] = 2 * kind + 1
                own[a + 1 : b] = [2 * kind + 2] * (b - a - 1)
            text, labels = text + s, labels + own
        return self.damage(text, labels)

    def damage(self, text: str, labels: list[int]) -> tuple[str, np.ndarray]:
        scanned, chars, out = self.chance(0.4), [], []
        wide, looks, hidden = self.chance(0.04), self.chance(0.06), self.chance(0.06)
        misread = {"o": "0", "O": "0", "l": "1", "i": "1", "e": "c", "a": "@", "t": "+", "I": "|", "0": "O", "1": "l", "5": "S"}
        column, width = 0, 80
        for c, label in zip(text, labels, strict=True):
            inside = label + 1 if label % 2 else label  # the label of a further character
            column += 1
            if scanned and c == " " and column > width - 6 and self.chance(0.4):
                c, column = "\n", 0
            elif scanned and column > width and c.isalpha() and self.chance(0.3):
                chars += [c, "-", "\n"]
                out += [label, inside, inside]
                column = 0
                continue
            elif scanned and self.chance(0.01):
                c = misread.get(c, c)
            elif wide and " " < c < "\x7f" and self.chance(0.3):
                c = chr(ord(c) + 0xFEE0)
            elif looks and self.chance(0.25):
                c = next((k for k, v in LOOK_ALIKE.items() if v == c), c)
            elif hidden and c == " " and self.chance(0.3):
                c = self.pick("  　 ")
            chars.append(c)
            out.append(label)
            if hidden and self.chance(0.03):
                chars.append(self.pick("​‌‍⁠﻿­"))
                out.append(inside)
        return "".join(chars), np.array(out, np.uint8)


def background(folder: str) -> list[str]:
    """Runs of sentences that no pattern suspects. Two neighbouring capitals are suspect where one of the words never stands in lower case in these records."""
    import pyarrow.parquet as pq

    blocks = pq.read_table(f"{folder}/blocks.parquet", columns=["text"]).column(0).to_pylist()
    data = pq.read_table(f"{folder}/children.parquet", columns=["data"]).column(0).to_pylist()
    texts = [t for t in blocks if t][: BACKGROUND * 3 // 4]
    for d in data[: BACKGROUND // 4]:
        try:
            texts.append(d.decode() if d else "")
        except UnicodeDecodeError:
            pass
    texts = sorted(set(texts))
    np.random.default_rng(5).shuffle(texts)
    known = Counter(w for t in texts for w in set(re.findall(r"\b[^\W\d_]{2,}\b", t)) if w.islower())

    def suspect(s: str) -> bool:
        if SUSPECT.search(s) or TITLED.search(s) or re.search(r"\b[A-ZÀ-Þ]\.\s?[A-ZÀ-Þ]", s):
            return True
        if any(not re.search(rf"\b(?:{NUMBERED})\b[^.]*$", s[: m.start()], re.I) for m in DIGITS.finditer(s)):
            return True
        return any(not (known[m[1].lower()] > 2 and known[m[2].lower()] > 2) for m in PAIR.finditer(s))

    out = []
    for t in texts:
        run = ""
        for s in END.split(t):
            if not s.strip() or suspect(s):
                run = ""
                continue
            run = f"{run} {s}" if run else s
            if len(run) > 60:
                out.append(run[:400])
                run = ""
        if run:
            out.append(run[:400])
    return out


def batch(maker: Maker, rows: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.zeros((length, rows), np.uint8), np.zeros((length, rows), np.uint8)
    for k in range(rows):
        text, labels = maker.row()
        codes = encode(text)
        at = int(maker.r.integers(0, max(1, len(codes) - length + 1)))
        part = codes[at : at + length]
        x[: len(part), k] = part
        y[: len(part), k] = labels[at : at + length]
    return x, y


def crf(e: np.ndarray, trans: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood per character, and its gradients in emissions and transitions. Forward and backward probabilities are scaled at each step."""
    steps, rows, n = e.shape
    k, top = np.arange(rows), e.max(2, keepdims=True)
    p, into = np.exp(e - top), np.exp(trans[:n])
    alpha, beta, scale = np.empty_like(p), np.ones_like(p), np.empty((steps, rows, 1), p.dtype)
    alpha[0] = p[0] * np.exp(trans[n])
    for t in range(steps):
        if t:
            np.multiply(alpha[t - 1] @ into, p[t], out=alpha[t])
        scale[t] = alpha[t].sum(1, keepdims=True)
        alpha[t] /= scale[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = (p[t + 1] * beta[t + 1]) @ into.T
        beta[t] /= scale[t + 1]
    total = (np.log(scale) + top).sum(0)[:, 0]
    de = alpha * beta
    dt = np.zeros_like(trans)
    dt[n] = de[0].sum(0)
    dt[:n] = into * (alpha[:-1].reshape(-1, n).T @ (p[1:] * beta[1:] / scale[1:]).reshape(-1, n))
    np.subtract.at(dt, (y[:-1].ravel(), y[1:].ravel()), 1)
    np.subtract.at(dt, (np.full(rows, n), y[0]), 1)
    at = np.arange(steps)[:, None]
    gold = trans[n][y[0]] + e[at, k, y].sum(0) + trans[y[:-1], y[1:]].sum(0)
    de[at, k, y] -= 1
    return float((total - gold).sum() / (steps * rows)), de / (steps * rows), dt / (steps * rows)


def lstm_back(recurrent: np.ndarray, x: np.ndarray, out: np.ndarray, kept: list, dh_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps, rows, h = out.shape
    d_table, d_rec = np.zeros((N_CLASSES, 4 * h), np.float32), np.zeros_like(recurrent)
    dh, dc = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32)
    dz_all = np.empty((steps, rows, 4 * h), np.float32)
    for t in range(steps - 1, -1, -1):
        z, before, tc = kept[t]
        i, f, o, g = z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :]
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = dz_all[t]
        dz[:, :h] = dc * g * i * (1 - i)
        dz[:, h : 2 * h] = dc * before * f * (1 - f)
        dz[:, 2 * h : 3 * h] = dh * tc * o * (1 - o)
        dz[:, 3 * h :] = dc * i * (1 - g * g)
        if t:
            d_rec += out[t - 1].T @ dz
        dh = dz @ recurrent.T
        dc = dc * f
    one = np.zeros((N_CLASSES, x.size), np.float32)
    one[x.ravel(), np.arange(x.size)] = 1
    d_table += one @ dz_all.reshape(-1, 4 * h)
    return d_table, d_rec


def start(seed: int, hidden: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = {}
    for side in "fb":
        w[f"table_{side}"] = r.normal(0, 0.15, (N_CLASSES, 4 * hidden)).astype(np.float32)
        w[f"table_{side}"][:, hidden : 2 * hidden] += 1.0
        w[f"rec_{side}"] = (r.normal(0, 1, (hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
    w["out"] = r.normal(0, 0.1, (2 * hidden, N_LABELS)).astype(np.float32)
    w["bias"] = np.zeros(N_LABELS, np.float32)
    w["bias"][0] = 2
    w["trans"] = np.zeros((N_LABELS + 1, N_LABELS), np.float32)
    for k in range(len(TYPES)):  # a later character follows only its own type
        for a in range(N_LABELS):  # a window may begin within an item
            if a not in (2 * k + 1, 2 * k + 2):
                w["trans"][a, 2 * k + 2] = NEG
    return w


def gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The loss of a batch and its gradient in each weight."""
    hidden, columns = w["rec_f"].shape[0], np.arange(x.shape[1])
    order = backward_order(len(x) - (x[::-1] != 0).argmax(0), len(x))
    turn = lambda a: a[order, columns]
    kf: list = []
    kb: list = []
    hf = lstm(w["table_f"], w["rec_f"], x, kf)
    hb = lstm(w["table_b"], w["rec_b"], turn(x), kb)
    both = np.concatenate([hf, turn(hb)], 2)
    loss, de, dt = crf(both @ w["out"] + w["bias"], w["trans"], y)
    de = de.astype(np.float32)
    g = {"trans": dt.astype(np.float32), "bias": de.sum((0, 1)), "out": both.reshape(-1, 2 * hidden).T @ de.reshape(-1, N_LABELS)}
    dh = de @ w["out"].T
    g["table_f"], g["rec_f"] = lstm_back(w["rec_f"], x, hf, kf, dh[:, :, :hidden])
    g["table_b"], g["rec_b"] = lstm_back(w["rec_b"], turn(x), hb, kb, turn(dh)[:, :, hidden:])
    return loss, g


def _worker(pipe, seed: int, sentences: list[str], rows: int, length: int) -> None:
    maker = Maker(seed, sentences)
    while True:
        x, y = batch(maker, rows, length)  # made while the others still learn
        w = pipe.recv()
        if w is None:
            return
        pipe.send(gradients(w, x, y))


def train(folder: str, out: str, seconds: float, processes: int = 8, seed: int = 11, begin: str | None = None, hidden: int = 40, rows: int = 64, length: int = 176) -> None:
    sentences = background(folder)
    print(f"{len(sentences)} background texts", flush=True)
    loaded = dict(np.load(begin)) if begin else start(seed, hidden)
    before = str(loaded.pop("how", ""))
    w = {k: a.astype(np.float32) for k, a in loaded.items()}
    frozen = w["trans"] <= NEG / 2
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    pipes = []
    for k in range(processes):
        here, there = multiprocessing.Pipe()
        multiprocessing.Process(target=_worker, args=(there, seed * 1000 + k, sentences, rows, length), daemon=True).start()
        pipes.append(here)
    began, step = time.time(), 0
    while (share := (time.time() - began) / seconds) < 1:
        step += 1
        for pipe in pipes:
            pipe.send(w)
        answers = [pipe.recv() for pipe in pipes]
        loss = float(np.mean([a[0] for a in answers]))
        g = {k: np.mean([a[1][k] for a in answers], 0) for k in w}
        g["trans"][frozen] = 0
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = float(0.012 * min(1, step / 30) * (1 - share) ** 0.8 * min(1, 0.5 / (norm + 1e-9)))  # a plain number keeps the weights at 32 bits
        for k in w:
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.005 * (g[k] * g[k] - v[k])
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.995**step)) + 1e-8)
        if step % 100 == 0:
            print(f"{time.time() - began:.0f} s, step {step}, loss {loss:.5f}", flush=True)
    for pipe in pipes:
        pipe.send(None)
    how = f"{before}; then " if before else ""
    how += f"seed {seed}, {seconds:.0f} seconds, {processes} processes, {step} steps of {processes * rows} rows, from {len(sentences)} background texts"
    np.savez(out, how=np.array(how), **w)
    print(how)
    for name, (recall, precision, n) in held_out(Tagger(w), sentences).items():
        print(f"{name}: recall {recall:.3f}, precision {precision:.3f} of {n} held-out spans")


def held_out(tagger: Tagger, sentences: list[str], rows: int = 2000, seed: int = 12) -> dict[str, tuple[float, float, int]]:
    """Recall, precision and number of spans of each type, over rows made of the held-out names, streets, places, sentences and background alone. A span counts where one of its type overlaps it by half."""
    maker = Maker(seed, sentences, held=True)
    made = [maker.row() for _ in range(rows)]
    counts = np.zeros((len(TYPES), 4), int)
    overlaps = lambda s, others: any(o[2] == s[2] and 2 * (min(s[1], o[1]) - max(s[0], o[0])) >= s[1] - s[0] for o in others)
    for (_, labels), got in zip(made, tagger.decode([t for t, _ in made]), strict=True):
        want = spans(labels)
        for k, name in enumerate(TYPES):
            a, b = [s for s in want if s[2] == name], [s for s in got if s[2] == name]
            counts[k] += sum(overlaps(s, got) for s in a), len(a), sum(overlaps(s, want) for s in b), len(b)
    return {name: (hit / max(1, want), right / max(1, found), int(want)) for name, (hit, want, right, found) in zip(TYPES, counts, strict=True)}


if __name__ == "__main__":
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    given = sys.argv[3:]
    train(sys.argv[1], sys.argv[2], *(t(a) for t, a in zip((float, int, int, str), given or ["900"], strict=False)))
