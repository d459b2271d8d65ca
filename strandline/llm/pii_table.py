"""The labelled table from which the model of personal information is trained.

Everyday sentences with slots; what fills a slot is labelled with the slot's kind. Fillers are drawn by
rules of public forms (numbering plans, postal conventions, identity numbers by country), from a fixed
seed: names, places and numbers are made up of syllables and digits. A third of the names, and half of the plain words, are such made-up
ones, so that the model learns shapes and surroundings rather than words.
"""

from __future__ import annotations

import random

# Given names of several languages, forms of address, particles of surnames.
GIVEN = (
    "Adam Ahmed Aisha Albert Alexander Alexandra Alfred Alice Ali Amina Amelia Ana Andrea Andreas Andrew Angela Anna Anthony Antonia Antonio Arthur Barbara Beatrice Bernard Bruno Carl Carla Carlos Caroline Catherine Cecilia Charles Charlotte Chen Christian Christine Christopher Clara Claudia Clemens Daniel David Deborah Diana Eduard Edward Elena Eleanor Elisabeth Elizabeth Emil Emilia Emily Emma Eric Esther Eva Fatima Felix Florian Frances Francis Frank Franz Frederick Gabriel Gabriele George Giulia Gregory Gustav Hannah Hans Harold Hassan Heinrich Helen Helena Henry Herbert Hermann Hiroshi Hugo Ingrid Irene Isaac Isabella Ivan Jacob James Jan Jane Javier Jean Jennifer Johannes John Jonathan Jorge Josef Joseph Juan Julia Julian Karin Karl Katarzyna Katharina Katherine Kofi Klara Krzysztof Lars Laura Leila Leo Lewis Linda Louise Lucia Ludwig Luis Luisa Magdalena Manuel Marco Margaret Maria Marianne Marie Mario Marta Martin Mary Matthias Max Mehmet Michael Miguel Miriam Mohammed Monica Natalia Ngozi Nicholas Nina Olga Oliver Omar Oscar Otto Patricia Paul Paula Pedro Peter Philip Pierre Piotr Priya Rachel Rajesh Rebecca Richard Robert Rosa Ruth Samuel Sarah Sebastian Simon Sofia Sophia Stefan Stephen Sven Teresa Thomas Tomasz Ursula Victor Walter Wei Werner William Yuki Yusuf"
).split()
TITLES = "Dr. Mr. Mr Mrs. Mrs Ms Ms. Miss Prof. Herr Herrn Frau Mme M. Mlle Pan Pani Señor Señora Sr. Sra. Sig. Signora Dhr. Dott. Sir Madame Monsieur".split()
PARTICLES = "van|von|de|da|di|del|della|den|ter|van der|van den|von der|de la|de los|al|el|bin|zu|le|dos".split("|")
SURNAMES = "Almeida Bauer Costa Dubois Eriksson Ferrari Gruber Haddad Ivanov Jensen Kowalski Lindqvist Moreau Nakamura Okafor Pereira Rahman Silva Tanaka Usman Visser Wagner Yilmaz Zhang".split()

_CONSONANTS, _CLUSTERS, _VOWELS = "bcdfghjklmnprstvwz", "br ch dr fl gr kl kr pr sch sh st th tr".split(), "aeiou"

# Words of streets, by language.
WAYS_EN = "Street St. St Road Rd Avenue Ave. Ave Lane Drive Close Square Court Terrace Boulevard Blvd. Way Crescent".split()
WAYS_DE = "straße str. strasse weg gasse allee platz ring ufer".split()
WAYS_FR = "rue|avenue|boulevard|place|chemin|impasse|quai|allée".split("|")
WAYS_ES = "Calle|Avenida|Plaza|Paseo|Camino|Ronda|C/".split("|")
WAYS_PL = "ul.|al.|os.|pl.".split("|")
WAYS_IT = "Via|Viale|Piazza|Corso|Largo".split("|")
WAYS_NL = "straat laan weg gracht kade plein".split()
BOXES = "PO Box|P.O. Box|P. O. Box|Post Office Box|Postfach|BP|B.P.|Boîte postale|Apartado|Apartado de Correos|Casella postale|Postbus|skr. poczt.".split("|")

# Sentences about nobody. <P> a place, <O> an office, <w> a word, <W> one with a capital, <n> a number, <N> a number that looks like a person's but isn't.
PLAIN = """
Bread <w> at <P> costs <n> more than in spring, and the <w> oven takes two <w> hours.
The ferry to <P> leaves at <t> from pier <n>; bring a <w> coat.
Nobody at <O> could say why the <w> <w> had been painted <w>.
Our choir sang <n> <w> songs in <P> on <d>, then walked back past the <w> mill.
<P> lies at <g>, roughly <n> km north of <P>.
Its <w> height is <n> m, its <w> width <n> m, according to <O>.
Ticket <N> was refunded because the <w> train to <P> never came.
Parcel <N> left the <w> depot on <d> at <t>.
Serial number <N>, model <c>, sold with a <w> charger.
ISBN <isbn> is out of print, says <O>.
Order no. <N> contains <n> <w> lamps and one <w> table.
Batch <N> passed every <w> test; lot <c> didn't.
The <w> recipe needs <n> g of flour, <n> ml of milk and a <w> pan.
Version <v> fixes the <w> crash, while <v> still shows it on <w> screens.
Server <ip> answered after <n> ms, <ip> stayed <w>.
On <d> the <W> River rose by <n> cm near <P>, <w> than in <y>.
Why did <P> lose <n>-<n> although <P> had <n> corners?
Chapter <n>, page <n>: the <w> storm reaches <P>.
Lot <c> went for $<n> and lot <c> for €<n>, both <w>.
In <y> <O> counted <n> <w> herons along the <W> Canal.
San <W> and New <W> have <w> winters, but Lake <W> freezes by <d>.
Mount <W>, Port <W> and Saint <W> Island belong to the <w> district.
Take bus <n> from <W> Street to <W> Square, then the <w> stairs.
The <W> <W> Company opened a <w> branch in <P>.
A <w> meeting of the <W> <W> Committee starts on <day> at <t>.
Press F<n>, choose <W>, then copy <path> to drive <n>.
See <url> for the <w> photos and <url> for the <w> map.
Checksum <hex> doesn't match <hex>, so download the <w> file again.
Revision <rev> replaced <rev>, which <rev> had quoted in <w> form.
"<W> and <W>" was a <w> play about <P> in <n> acts.
I think <P> is <w>, you find <P> <w>; both maps say <w>.
Happy <day>! The <w> garden opens from <t> to <t>.
Windows <n>, Office <y> and Python <v> were <w> on the <w> laptop.
Score: <n>:<n>, half time <n>:<n>, attendance <big>.
Total <big> <w>, of which <big> in <P> and <n>% elsewhere.
Figure <n>.<n> and Table <n> list the <w> samples from <P>.
Im Garten von <P> blühen <n> <w> Rosen, obwohl der <w> Winter lang war.
Das <w> Museum in <P> zeigt ab <d> rund <n> Bilder und eine <w> Sammlung.
Artikel <N> ist am <d> in <P> angekommen, Paket <c> noch nicht.
Der Bus nach <P> fährt um <t>, danach erst wieder am <day>.
Warum kostet das <w> Brot bei <O> plötzlich <n> Euro?
Le marché de <P> ouvre à <t> ; on y trouve <n> sortes de <w> fromages.
La rivière a monté de <n> cm près de <P>, selon <O>.
Référence <N>, taille <n>, couleur <w> : livré le <d>.
Pourquoi la <w> gare de <P> reste-t-elle fermée le <day> ?
El tren de <P> llegó con <n> minutos de retraso y un <w> aviso.
Pedido <N>: <n> sillas y una mesa <w> para <O>.
¿Por qué la plaza de <P> está <w> desde el <d>?
Pociąg do <P> odjeżdża o <t>, a bilet nr <N> kosztuje <n> zł.
W <P> spadło <n> mm deszczu, <w> niż w <y> roku.
Il mercato di <P> apre alle <t> con <n> banchi e un <w> bar.
De boot naar <P> vertrekt om <t>, kaartje <N> is <w>.
-- <h>
-- <h>
<w> <w> <w> -- <h>
#<n> and #<n> are <w>; set <c> stays.
@<W> did you see the <w> goal at <t>?
if (x < <n> && y > <n>) return <w>[<n>] * <n>;
| <W> | <n> | <w> | <n> |
* <w> <w> (<n>)
<Pre> <P> <w> <w> <w> <n> <w>.
<Pre> <P>, <w> <w> <w> <w>.
<Pre> <P>, la <w> <w> <w>.
<Pre> <P>, le <w> <w>; <w> <n>.
<Pre> <P> <w> <n> <w>, <w>. <Pre> <P>, <w> <w>.
Kolega z <P> <w> <w> <w>.
Pewna pani z <P> <w> <w>, choć <w>.
Ein Freund aus <P> <w> die <w> <De>.
Una amiga de <P> <w> la <w>.
Un ami de <P> <w> le <w> <w>.
A friend from <P> <w> the <w>.
<Team> <P> <w> <w> <w>.
<Pre> <O> <w> <w> <w>.
<w> <w>. <Pre> <P> <w> <w> <w> <c> <w> <w>.
<Team> <P> <w> <w> nr <n>, <w> <w>.
<Team> <P> and <Team> <W> <w> at <t>.
Die <w> <De> von <P> war <w>, die <w> <De> bei <P> auch.
Die <w> <De> von <P> <w> <w>.
Das <w> <De> von <P> steht bei der <w> <De>.
Unsere <De> von <P> ist <w>, eine <De> von <P> fehlt.
Der <w> <De> mit <n> <De> steht in <P>, nahe der <w> <De>.
<De> <c> liegt in der <w> <De> mit <n> <De>.
La <w> <n> de <P>, clave <c> de la <w>, está <w>.
Le <w> <c> de la <w> près de <P> compte <n> <w>.
Train <dt>, platform <n>; log of <dt>: <n> <w>.
<w> <dt>, <ratio> <w> of <P>
Grade <ratio>, shelf <ratio>, roughly <D> percent for <P>.
├── <w>_<n>
└── <w>_<n> ± <n> ≈ <n>
∑ <n> × <n> ≤ √<n>, so ≈ <n>
Музей <P> №<n>, вход <n>, касса <n>.
<x> <P> №<n>, <x> <n>, <x> <n>, <x> <n>.
<x> <n>, <x> <n> (<P>), <x> <n>.
<x> <w> <x>, <n> <x> <P>.
<x> <P> <n>, <w> <x> <P>.
<w> <t>, <w> <c>, <P>.
<W> <t>, <w> <c>, <P> <w>.
<w> <c>, <P>; <w> <n>, <P>.
Stage <n>, <P>: <w> <c>, <P>, <t>.
It was <n> °C at <P>, or <n> C near <P>, <w> <w>.
Row <ratio>, seat <ratio>; map sheet <ratio>. <W> <w>
<P> São <W> <n>: <w> «<W>», <P> Santa <W> <n>.
In <P> gibt es <n> <w> <De>, in <P> hat niemand <n> <w>.
À <P>, <w> <w> <w>.
À <P> <w>, <w> <w>.
W <P> <w> <w> <w> <c>.
<P> <w> <w> and <P> <w>, <w>.
<W> <w> und <w> <De>, <w> bei <P>, <w>.
«<W>» costs £<n> © <n>, ¿<w>? ±<n> <P> São <W>
{<w>} <n> stays <n>, tab <n>; "<W> <W>" <n>.
<W> <n> of the <P> <w>: <w> <W>, <n>.
We <w>. I <w>, but <P> <w>. It <w> <n> <w>.
<W>: <n>; <W>: <n>; <W>: <n>
<W> <w> <w> <n> <w> <P> <w>, <w> <w> <w>.
<P> <w> <w> <c> <w> <O>.
<w> <P>, <P> <w> <n>.
""".strip().split("\n")

# Sentences with personal information: {name}, {email}, {phone}, {id}, {address}.
LABELLED = """
{name} baked the <w> cake.
{name} told me about <P>.
Yesterday {name} called from <P> and <w> a <w> room.
The <w> dog belongs to {name}, who lives near <P>.
We met {name} and {name} at <O>.
Signed by {name} on <d>
A <w> letter from {name} arrived on <d>.
Thank you, {name}, for the <w> soup!
Is {name} coming on <day>?
{name} wrote: the <w> bridge is <w>.
Hello {name}, your <w> bike is ready.
Dear {name},
Kind regards, {name}
Yours sincerely\n{name}
Please ask {name} for the <w> key
according to {name} it was <w>
<w> <w> {name} <w>
<w> <w> <w> by {name}.
<w> <w> with {name}, <w> <w>
<w> <w> ({name}) <w>
<W> <w> <w>, says {name}.
{name}: <w> <w> <n>
{name} <w> the <w> <w> in <y>.
{name} <w> <w> <w> at <O>.
{name} <verb> <n> <w> for the <w> <w>.
The <w>, {name}, <w> <w> <w>.
<W> <w>, {name}, <w> <n> <w>.
Notre <w> {name} <w> du <w>.
Jeder <w> {name} <w>.
<w> <w> <w> and {name}.
<W> <w> <w> for the <w> <w> and {name}. <W> <w> <w>
{id} was <w> by <O>.
<w> <w> <n>: {id} <w> <w>
<w> <w> <n>: {phone} <w> <w>
<W> <w> <n>: {address} <W> <w>
Der <w> <De> ging an {address}.
La <w>, {name}, <w> <n> <w>.
<W> {phone} before <t> <w>.
<mailcue>: {email}, {phone}
{id} is <w>, <w> <w>
{id} and {id} <w> <w>
A <w> slip with {id} lay under the <w> lamp
<w> <w> under {id} <w> <w>
<w> <w>, {id} <w> <w>
<n> <w>. {name} <verb> <n> <w>
{name} <verb> the <w> <w>.
I <verb> {name} to <w> <w> <n>.
We <verb> {name}, <w> <w> too.
<verb> {name} for <n> <w>!
<Pre> {name} <w> <w>.
{name} is on {phone} <w> <w>
{name} on {phone} <w> <w>.
{name} ({id}) <w> <n>.
Find {name} under {phone} after <t>
{name} ({email}) plays the <w> flute.
{name} ({phone}) plays the <w> flute.
{name} ({id}) rented flat <n>.
{name}, {address}
{name}, {phone}
{name}\n{address}\n{phone}
{name}\n{address}\n{email}
{address}\n{phone}
<w> <w>.\n{name}\n{address}\n{email}\n<W> <w> <w>
{address}\n{email}
{address}\n{phone}
<w> <w>.\n{name}\n{address}\n{email}\n<W> <w> <w>
Gestern hat {name} im <w> Chor gesungen.
Liebe Grüße, {name}
Sehr geehrte {name}, Ihr <w> Rad ist fertig.
Der <w> Hund gehört {name} aus <P>.
{name} a réparé la <w> porte hier.
Bonjour {name}, votre <w> vélo est prêt.
Ayer {name} trajo una <w> tarta a <P>.
Estimada {name}, gracias por el <w> libro.
Wczoraj {name} upiekła <w> ciasto.
Ieri {name} ha cantato a <P>.
Gisteren heeft {name} in <P> gezongen.
<telcue> {phone}
<telcue> {phone}, after <t>
<telcue>: {phone}.
You can <telverb> {phone} until <t>.
My new number is {phone}, the <w> one is off.
Text me on {phone} when the <w> bus stops
{phone} is busy, try {phone}
Try {phone} or {phone} <w>
<W> {phone} or {phone}.
<w> <w> {phone}.
<w> <w> ({phone}), <w> <w>
<w> <w> <telverb> {phone} <w> <w>
<W> <w> at {phone} <w> <w>
{phone} <w> <w>
Meine Nummer ist {phone}, ruf nach <t> an.
Mon numéro : {phone}
Mi número es {phone}, llame el <day>.
Mój numer to {phone}.
<mailcue> {email}
<mailcue>: {email}.
Send the <w> recipe to {email} please
Photos go to {email} or {email}, <w> <w>.
<w> <w> {email}.
<w> <w> ({email}) <w>
<W> <w> via {email}, <w> <w> <w>
{email} <w> <w> <w>
Bitte schreibt an {email} bis <d>.
Écrivez à {email} avant <t>.
Escriba a {email} antes del <d>.
Napisz na {email} do <d>.
{id}
<idcue> {id}
<idcue>: {id}.
<idcue> {id}, valid until <d>.
His <idcue> is {id}, issued in <P>.
The <w> form asks for {id} and a <w> photo
<w> <w> {id}.
<w> <w> ({id}) <w> <w>
<W> <w> under {id} <w> <w>
Quoted on the <w> form: {id}
{id} <w> <w> <w>
Bitte {id} angeben.
Numéro : {id}, délivré le <d>.
<addrcue> {address}
<addrcue>: {address}.
She moved to {address} in <y>.
The <w> piano stands at {address}, second floor
Meet us in front of {address} at <t>.
<w> <w> {address}.
<w> <w> ({address}) <w>
<W> <w> from {address}, <w> <w>
<W> <w> at {address} <w> <w>
{address}
Ich wohne in der {address}.
J'habite {address}.
Vivo en {address}.
Mieszkam przy {address}.
{urlfield}
See {urlfield} for <w> <w>.
<w> <w> {urlfield} <w>
""".strip().split("\n")
LABELLED = [s.replace("\\n", "\n") for s in LABELLED]

CUES = {
    "telcue": "tel. |Tel.: |phone |Phone: |mobile |Telefon |Handy |Fax |Ring |tél. |Tél : |teléfono |móvil |telefon |tel/fax |cell |WhatsApp |Call |call |dial ",
    "telverb": "call |ring |dial |phone |text |reach us on |reach me at ",
    "mailcue": "mail |e-mail |E-Mail |email: |Mail: |write to |cc |contact |courriel |correo ",
    "idcue": "passport |passport no. |tax no. |SSN |social security number |national ID |ID card |tax ID |tax number |IBAN |account |bank account |Steuer-ID |Ausweis |Ausweis-Nr. |Personalausweis |NIF |DNI |PESEL |NIP |codice fiscale |BSN |VAT ID |national insurance number |driving licence |numéro fiscal |paszport |credit card ",
    "addrcue": "lives at |deliver to |ship to |address |Address: |Anschrift: |Adresse : |visit us at |home is |office at |adres |post it to ",
}
CUES = {k: [x.strip() for x in v.split("|")] for k, v in CUES.items()}
#: Words that begin a sentence before a place, names of groups, nouns and verbs.
BEGINNINGS = "In|At|Near|From|Under|Around|Outside|Beyond|Without|Besides|Inside|Over|Like|Because|When|Where|Since|Only|Perhaps|Also|Bei|Nach|Aus|Seit|Von|Zwischen|Über|Unter|Laut|Hinter|À|Près de|Selon|Chez|Vers|Depuis|En|Desde|Hasta|Según|Sobre|Cerca de|W|Na|Przy|Pod|Koło|Według|Da|Presso|Secondo|Vicino a|Bij|Naar|Em".split("|")
_TEAMS = "Team|Club|Hotel|Café|Projekt|Gruppe|Verein|Équipe|Groupe|Equipo|Grupo|Zespół|Klub|Grupa|Squadra|Harbour|Station|Castle|Bridge".split("|")
_FOREIGN = "Порт Озеро Мост Рынок Вокзал Остров Λιμάνι Πύργος Πλατεία Νησί chợ cầu núi hồ Île Îlot Øst Åsen Çarşı Ponte 港口 東京 한강".split()
_NOUN_ENDINGS = "ung heit keit schaft plan buch zeug haus stück gabe lage stelle er el e ei gerät weg tag rück nis sel".split()
_NOUNS = "Straße Brücke Liste Zahl Woche Stunde Küche Größe Tür Stück Häuser Zeile Reihe Punkte Mauer Stadt Schule Reise".split()
_VERBS = "asked thanked saw visited helped paid phoned followed invited hired trusted thanks wrote signed sent sold read owes told met praised taught".split()
_ENDINGS = "us ius ia a etta ette ine ina el iel ard ert win mund fried helm slav mir ita isa ke lde run olf ald eth is as o en an yn ie".split()
_DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday Montag Dienstag lundi mardi lunes martes sobota".split()
_MONTHS = "January February March April May June July August September October November December".split()
_COMMON = (
    "a an this that our some every little old new warm cold green heavy narrow quiet early late very rather bought cooked found kept lost moved opened painted repaired sold washed wrote grows sleeps waits walks until while because although under beside between toward kitchen window garden bicycle umbrella lantern basket ladder "
    "schnell immer wieder nicht sehr kleine große und oder mit für le une petite grand avec pour sans très el una pequeña grande con para sin muy mały duża bardzo oraz przez il una piccolo con molto een klein met zeer"
).split()
_BODIES = "Office Bureau Institute Agency Society Museum Library Council Ministry Registry Department Centre Foundation Board University Hospital".split()
#: What stands before numbers of people, and before those of things, is drawn with the same number.
_SHAPES = ("999-99-9999", "999-999-9999", "99 99 99 99", "999999999", "99999999999", "999 999 999", "9999-9999-9999", "99-9999999", "9999.9999.99", "99-999-999", "0999-9999-9999", "09-999-99999", "@@999999", "@@-9999-99", "999/9999/99", "9999999")


class Drawer:
    """Draws examples: (text, [(begin, end, kind)])."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def one(self, values):
        return values[int(self.r.random() * len(values))]

    def syllables(self, n: int, ends: str = "") -> str:
        out = "".join((self.one(_CLUSTERS) if self.r.random() < 0.12 else self.one(_CONSONANTS)) + self.one(_VOWELS) for _ in range(n))
        return out + (self.one(ends) if ends else "")

    def place(self) -> str:
        x = self.syllables(self.one([1, 2, 2, 3]), self.one(["", "nmrkxltsp"])).capitalize()
        y = self.r.random()
        return x if y < 0.8 else x + self.one(["burg", "ton", "ville", "stadt", "ów", "grad"]) if y < 0.9 else self.one(["San", "New", "Port", "Bad", "Saint", "Lake", "Santa", "Los"]) + " " + x

    def office(self) -> str:
        p, b, w = self.place(), self.one(_BODIES), self.word().capitalize()
        return self.one([f"the {p} {b}", f"the {p} {w} {b}", f"the {b} of {w}", f"the {b} for {w} and {self.word().capitalize()}", f"{p} {b}", f"the {w} {b} in {p}", f"{p} {w} {b}"])

    def word(self) -> str:
        return self.one(_COMMON) if self.r.random() < 0.5 else self.syllables(self.one([1, 2, 2, 3]), self.one(["", "rnstdle", "dnty"]))

    def digits(self, shape: str) -> str:
        """A shape with 9 for any digit, 8 for any but 0, and @ for any capital."""
        return "".join(self.one("0123456789") if c == "9" else self.one("123456789") if c == "8" else self.one("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c == "@" else c for c in shape)

    def number(self) -> str:
        return str(self.r.randrange(1, 10 ** self.one([1, 2, 2, 3, 4, 5])))

    def handle(self) -> str:
        g, p, n = self.one(GIVEN), self.syllables(2).capitalize(), self.number()
        return self.one([g + p, f"{g}_{p}", f"{g}.{p}", p + self.one(_BODIES), f"{g.lower()}_{self.word()}", f"{p}{n}", f"The{p}{self.one(_BODIES)}", f"Dr.{g[0]}.{p}", f"{g}{self.one(_MONTHS)[:3]}{self.r.randrange(1, 29)}", f"{p}-{self.one(_BODIES)[:3].lower()}"])

    def field(self, what: str) -> str:
        r = self.r
        day, month, year = r.randrange(1, 29), r.randrange(1, 13), r.randrange(1950, 2030)
        if what in CUES:
            return self.one(CUES[what])
        return {
            "P": self.place, "O": self.office, "w": self.word, "W": lambda: self.word().capitalize(), "n": self.number, "N": lambda: self.digits(self.one(_SHAPES)), "h": self.handle, "y": lambda: str(year),
            "x": lambda: self.one(_FOREIGN), "Pre": lambda: self.one(BEGINNINGS), "Team": lambda: self.one(_TEAMS), "De": lambda: self.one(_NOUNS) if r.random() < 0.4 else (self.syllables(self.one([1, 2]), self.one(["", "nrlhß"])) + self.one(_NOUN_ENDINGS)).capitalize(), "verb": lambda: self.one(_VERBS), "D": lambda: f"{r.uniform(0, 99):.{self.one([1, 2, 3, 4])}f}", "ratio": lambda: f"{r.randrange(1, 10 ** self.one([1, 2, 5]))}/{r.randrange(1, 40)}",
            "dt": lambda: f"{year}-{month:02}-{day:02}{self.one([' ', ' ', 'T'])}{r.randrange(24):02}:{r.randrange(60):02}",
            "c": lambda: self.one([f"{self.syllables(1)}-{r.randrange(1000, 999999)}", self.digits("@@-9999"), self.digits("@999"), f"{self.syllables(1).upper()}{r.randrange(10, 999)}", self.digits("@9-99"), self.digits("@9-9999")]),
            "t": lambda: f"{r.randrange(24):02}:{r.randrange(60):02}" + self.one(["", "", f":{r.randrange(60):02}"]), "day": lambda: self.one(_DAYS),
            "d": lambda: self.one([f"{year}-{month:02}-{day:02}", f"{day}.{month}.{year}", f"{day}/{month}/{year}", f"{day} {_MONTHS[month - 1]} {year}", f"{_MONTHS[month - 1]} {day}", f"{day}.{month:02}.", f"{year}/{month:02}/{day:02}"]),
            "g": lambda: self.one([f"{r.uniform(-89, 89):.4f}, {r.uniform(-179, 179):.4f}", f"N {r.randrange(89)}° {r.uniform(0, 59):.3f}", f"{r.randrange(89)}°{r.randrange(59)}'N {r.randrange(179)}°{r.randrange(59)}'E"]),
            "v": lambda: ".".join(str(r.randrange(20)) for _ in range(self.one([2, 3, 3, 4]))), "ip": lambda: ".".join(str(r.randrange(1, 255)) for _ in range(4)), "hex": lambda: "".join(self.one("0123456789abcdef") for _ in range(self.one([8, 12, 32]))),
            "isbn": lambda: self.digits(self.one(["978-9-99-999999-9", "9789999999999", "979-99-999-9999-9", "9-999-99999-9"])), "big": lambda: f"{r.randrange(1000, 9999999):,}", "path": lambda: f"C:\\{self.word()}\\{self.word()}_{r.randrange(99)}",
            "rev": lambda: f"{self.syllables(1)}~{self.place().replace(' ', '')}@{r.randrange(1, 99)}",
            "url": lambda: self.one(["https://", "http://", "//", "https://www.", "www."]) + f"{self.syllables(2)}.{self.one(['example', 'test', 'org'])}/{self.word()}" + self.one(["", f"/{year}/{month:02}/{day:02}", f"?id={r.randrange(10**9)}", f"#{self.word()}-{r.randrange(999)}", f"?{self.word()}={self.place().replace(' ', '+')}+{self.one(_BODIES)}"]),
        }[what]()

    def fill(self, text: str) -> str:
        out = []
        for k, part in enumerate(text.replace(">", "<").split("<") if text.count("<") == text.count(">") else [text]):
            known = k % 2 and part in _FIELDS
            out.append(self.field(part) if known else f"<{part}>" if k % 2 else part)
        whole = "".join(out)
        return whole[:1].upper() + whole[1:] if self.r.random() < 0.5 else whole

    def given(self) -> str:
        """One of the list, or one made up with an ending that given names have."""
        x = self.r.random()
        return self.one(GIVEN) if x < 0.6 else self.accented((self.syllables(self.one([1, 2, 2]), self.one(["", "nslr"])) + (self.one(_ENDINGS) if x < 0.85 else "")).capitalize())

    def accented(self, name: str) -> str:
        """Sometimes with a letter that isn't ASCII."""
        if self.r.random() > 0.2:
            return name
        k = self.r.randrange(len(name))
        other = dict(zip("aeiouslznc", ("äáåã", "éèê", "íï", "öøóô", "üúů", "šş", "ł", "žż", "ñń", "ćç"))).get(name[k].lower(), name[k])
        letter = self.one(other)
        return name[:k] + (letter.upper() if name[k].isupper() else letter) + name[k + 1 :]

    def surname(self) -> str:
        x = self.r.random()
        s = self.one(SURNAMES) if x < 0.12 else (self.syllables(self.one([1, 2, 2, 3])) + self.one(["", "", "n", "rn", "ld", "nt", "sky", "er", "son", "ez", "wicz", "ova", "ini", "sen", "nathan", "oğlu", "mann"])).capitalize()
        s = self.accented(s)
        return s if x < 0.92 else self.one(["O'", "Mc", "Al-", "El-", "D'", f"{self.one(SURNAMES)}-"]) + s

    def name(self) -> str:
        g, s, x = self.given(), self.surname(), self.r.random()
        if x < 0.34:
            return f"{g} {s}"
        if x < 0.44:
            return f"{g[0]}. {s}" if x < 0.41 else f"{g[0]}. {self.given()[0]}. {s}"
        if x < 0.54:
            return f"{self.one(TITLES)} {s}"
        if x < 0.62:
            return f"{self.one(TITLES)} {g} {s}"
        if x < 0.72:
            return f"{s}, {g}"
        if x < 0.78:
            return f"{g}-{self.given()} {s}"
        if x < 0.85:
            return f"{g} {self.one(PARTICLES)} {s}" if x < 0.835 else f"{self.one(PARTICLES)} {s}, {g}"
        if x < 0.90:
            return f"{g} {s.upper()}"
        if x < 0.95:
            return f"{g} {self.one('ABCDEFGHJKLMNPRSTW')}. {s}"
        return f"{g} {self.given()} {s}"

    def user(self) -> tuple[str, list[str]]:
        g, s, d = self.given().lower(), self.surname().lower().replace("'", ""), self.syllables(2, "nrst").lower()
        user = self.one([f"{g}.{s}", f"{g[0]}_{s}", f"{s}{self.r.randrange(99)}", f"{g}+{self.word()}", f"{g}_{s}", f"{g}-{s}", f"{g[0]}{s}", g, f"{self.word()}.{self.word()}"])
        return user, self.one([[d, "example"], [f"{d}-{self.word()}", "test"], ["mail", d, "example"], [d, "com"], [d, "org"], [d, "co", "uk"], [d, "de"]])

    def email(self) -> str:
        user, parts = self.user()
        x = self.r.random()
        if x < 0.4:
            return f"{user}@{'.'.join(parts)}"
        if x < 0.48:
            return f"{user}@{'.'.join(parts)}".upper()
        if x < 0.56:
            return f"mailto:{user}@{'.'.join(parts)}"
        if x < 0.62:
            return f"{user}{self.one([' @ ', '[@]', '(@)'])}{'.'.join(parts)}"
        a, b = self.one("([{ "), ""
        b = {"(": ")", "[": "]", "{": "}", " ": " "}[a]
        at, dot = f"{a}{self.one(['at', 'AT'])}{b}", f"{a}{self.one(['dot', 'DOT'])}{b}"
        if a != " " and self.r.random() < 0.5:
            at, dot = f" {at} ", f" {dot} "
        return user + at + (dot if self.r.random() < 0.7 or a == " " else ".").join(parts)

    def groups(self, total: int) -> list[int]:
        out = []
        while total:
            n = min(total, self.one([2, 3, 3, 4, 4, 5]))
            n = total if total - n == 1 else n
            out.append(n)
            total -= n
        return out

    def phone(self) -> str:
        """An international or national number, its digits grouped in any usual way."""
        sep, x = self.one([" ", " ", "-", "-", ".", ""]), self.r.random()
        body = sep.join(self.digits("9" * n) for n in self.groups(self.r.randrange(6, 10)))
        area = self.digits(self.one(["89", "899", "8999"]))
        country = self.digits(self.one(["8", "89", "89", "899"]))
        if x < 0.35:
            return f"{self.one(['+', '+', '00'])}{country}{sep or ' '}{self.one([area, area, f'({area})', f'(0){area}', f'(0{area})', f'0{area}'])}{sep}{body}"
        if x < 0.45:
            return f"(0{area}){self.one([' ', '', '-'])}{body}"
        if x < 0.55:
            return f"({self.digits('899')}){self.one([' ', '-'])}{self.digits('999')}{self.one(['-', ' ', '.'])}{self.digits('9999')}"
        if x < 0.65:
            return f"0{area}{self.one(['/', '/', ' / ', '-', ' '])}{body if x < 0.6 else self.digits('9' * self.r.randrange(5, 9))}"
        if x < 0.72:
            return f"0{self.digits('8' + '9' * self.r.randrange(7, 10))}"
        if x < 0.8:
            sep = sep or " "
            return "0" + sep.join([self.digits("8"), *(self.digits("99") for _ in range(4))]) if x < 0.77 else "0" + self.digits("8") + sep + sep.join(self.digits("99") for _ in range(4))
        if x < 0.9:
            sep = sep or "-"
            return self.digits(self.one([f"899{sep}999{sep}9999", f"1{sep}899{sep}999{sep}9999", f"899{sep}9999{sep}999", f"899{sep}999{sep}999"]))
        return f"+{country}{area}{self.digits('9' * self.r.randrange(6, 9))}"

    def id(self, named: bool = True) -> str:
        """A number of a person by the forms that countries use; those that could be anything need the word before them (``named``)."""
        forms = [
            "899-99-9999", "899-99-9999", "@@ 99 99 99 @", "@@ 99 99 99 @", "@@99 9999 9999 9999 9999 99", "@@99999999999999999999", "@@99 @@@@ 9999 9999 9999 99", "@@99@@@@99999999999999", "@@99 9999 9999 9999 9999 9999", "8 99 99 99 999 999 99", "99999999@", "@9999999@", "@@@@@@99@99@999@",
            "999999/9999", "9999 9999 9999 9999", "@99@99@99", "@99@99999",
        ]
        more = ["9999-9999-9999-9999", "@@999999999", "@9999999", "@@999999@", "99 999 999 999", "99999999999", "999999999", "999-999-99-99", "99.99.99-999.99", "@9@@9@@@9", "@9@@99@9", "999999-9999", "999999/9999"]
        return self.digits(self.one(forms + more if named else forms))

    def address(self) -> str:
        n, p = str(self.r.randrange(1, 300)), self.place()
        s = self.syllables(self.one([1, 2, 2]), self.one(["", "nrlt"])).capitalize()
        s = s if self.r.random() < 0.6 else self.one("Mill Park Church Station High Main Garden Bridge Queen King Oak Maple Market North South".split())
        five, x = self.digits("99999"), self.r.randrange(13)
        if x <= 1:
            return f"{n}{self.one(['', '', 'a', 'B'])} {s} {self.one(WAYS_EN)}, {p}" + self.one(["", f" {five}", f", {self.digits('@@')} {five}", f" {self.digits('@@8 9@@')}", f", {self.digits('9999')} {self.place()}"])
        if x == 2:
            return f"{n} {s} {self.one(WAYS_EN)}, {self.digits('9999')} {p}"
        if x == 3:
            return f"{self.one(['Flat', 'Apt', 'Apt.', 'Unit', 'Suite'])} {self.r.randrange(1, 40)}, {n} {s} {self.one(WAYS_EN)}, {p}"
        if x in (4, 5):
            way = self.one(WAYS_DE)
            return self.one([f"{s.lower().capitalize()}{way}", f"{s}-{way.capitalize()}"]) + f" {n}{self.one(['', '', 'b', ' c', 'a'])}" + self.one([f", {five} {p}", f", {five} {p}", f", {self.digits('9999')} {p}"])
        if x == 6:
            return f"{n}{self.one([',', '', ' bis,'])} {self.one(WAYS_FR)} {self.one(['', 'de ', 'du ', 'des ', 'de la '])}{s}, {five} {p}"
        if x == 7:
            return f"{self.one(WAYS_ES)} {self.one(['', 'del ', 'de la '])}{s} {n}, {self.one(['', f'{self.r.randrange(1, 9)} {self.one(list(chr(65 + k) for k in range(4)))}, ', f'{self.r.randrange(1, 9)}º, '])}{five} {p}"
        if x == 8:
            return f"{self.one(WAYS_PL)} {s} {n}{self.one(['', '/' + str(self.r.randrange(1, 40))])}, {self.digits('99-999')} {p}"
        if x == 9:
            return f"{self.one(WAYS_IT)} {s} {n}, {five} {p}"
        if x == 10:
            return f"{s}{self.one(WAYS_NL)} {n}, {self.digits('9999 @@')} {p}"
        return f"{self.one(BOXES)} {self.r.randrange(1, 99999)}" + self.one([f", {p}", f", {p}", f", {five} {p}", f", {p} {five}"])

    def urlfield(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A link with something personal in it."""
        head = self.one(["https://", "http://", "//", "https://www.", "www."]) + f"{self.syllables(2)}.{self.one(['example', 'test', 'org'])}/" + self.one([f"{self.word()}?", f"{self.word()}/{self.word()}?{self.word()}={self.r.randrange(999)}&", "?"])
        kind = self.one(["email", "email", "name", "phone", "id_number"])
        key = {"email": "mail m to email user cc q", "name": "name author who by q", "phone": "tel phone call q", "id_number": "ssn passport iban id"}[kind]
        if kind == "email":
            user, parts = self.user()
            value = f"{user}{self.one(['%40', '%40', '@'])}{'.'.join(parts)}"
        elif kind == "name":
            value = f"{self.given()}{self.one(['+', '%20', '_'])}{self.surname()}"
        elif kind == "phone":
            value = self.one(["%2B", "+", "00"]) + self.digits("8" + "9" * self.r.randrange(9, 12))
        else:
            value = self.digits(self.one(["899-99-9999", "@@99999999999999999999", "@@999999@"]))
        head += self.one(key.split()) + "="
        tail = self.one(["", "", f"&{self.word()}={self.number()}"])
        return head + value + tail, [(len(head), len(head) + len(value), kind)]

    def example(self, template: str) -> tuple[str, list[tuple[int, int, str]]]:
        text, spans, rest = "", [], template
        while any(f"{{{k}}}" in rest for k in KINDS_OF_SLOTS):
            at = min(rest.index(f"{{{k}}}") for k in KINDS_OF_SLOTS if f"{{{k}}}" in rest)
            text += self.fill(rest[:at])
            slot = rest[at + 1 : rest.index("}", at)]
            if slot == "urlfield":
                value, inner = self.urlfield()
                spans += [(a + len(text), b + len(text), k) for a, b, k in inner]
            else:
                # Often a word says what the number is.
                cued = f"<{_CUE_OF[slot]}>" in template if slot in _CUE_OF else False
                if slot in _CUE_OF and not cued and self.r.random() < 0.4:
                    text, cued = text + self.one(CUES[_CUE_OF[slot]]) + " ", True
                value = self.id(cued) if slot == "id" else getattr(self, slot)()
                spans.append((len(text), len(text) + len(value), KINDS_OF_SLOTS[slot]))
            text += value
            rest = rest[rest.index("}", at) + 1 :]
        return text + self.fill(rest), spans


_CUE_OF = {"id": "idcue", "phone": "telcue"}
KINDS_OF_SLOTS = {"name": "name", "email": "email", "phone": "phone", "id": "id_number", "address": "address", "urlfield": ""}
_FIELDS = {*CUES, *"P O w W n N h y c t day d g v ip hex isbn big path rev url x Pre Team De verb D ratio dt".split()}


def garbled(text: str, d: Drawer) -> str:
    """A text as it looks when it was read in a wrong encoding."""
    return text.encode().decode(d.one(["cp1252", "cp1251", "mac_roman", "cp437"]), "replace")


def table(n: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """n labelled texts of one to three sentences."""
    d, out = Drawer(seed), []
    while len(out) < n:
        text, spans = "", []
        for _ in range(d.one([1, 1, 2, 3])):
            template = d.one(LABELLED) if d.r.random() < 0.62 else d.one(PLAIN)
            more, found = d.example(template)
            if not found and d.r.random() < 0.08:
                more = garbled(more, d)
            spans += [(a + len(text), b + len(text), k) for a, b, k in found]
            text += more + d.one([" ", "\n", " "])
        text = text.rstrip()
        out.append((text + d.one([" ", "\n"]) + "-- " + d.handle() if d.r.random() < 0.3 else text, spans))
    return out
