"""The small labelled table of the personal-information tagger.

Rows are texts with the labelled spans in double brackets: [[kind|text]]. A fixed random generator writes them from the
grammar below, so the table is the same in every process: a lead, a value and a tail in several languages, values in the
usual written forms (groups of digits of any size for numbers, street types of several languages, contact-card and link
schemes), ordinary sentences, source code, logs and things that only look alike (order, part, book and version numbers,
handles, repositories, firms, places). Half of the names, roads and places are common ones, half are made of syllables, so
the field learns how values stand in text rather than which they are.

Nothing in here was taken from tables that are to be tagged. `held_out` frames are kept from training and serve to measure.
"""

from __future__ import annotations

import random
import re

KINDS = ("email", "phone", "id_number", "street_address", "person_name")

GIVEN = "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Thomas Karen Daniel Nancy Kevin Helen George Ruth Lars Ingrid Hans Greta Klaus Sabine Uwe Heike Pierre Camille Julien Sophie Jean Margaux Carlos Lucia Miguel Elena Paweł Agnieszka Zofia Ivan Olga Boris Wei Mei Hiroshi Keiko Fatima Omar Priya Arjun Bob Jane Ann Joe Tim Kate".split()
FAMILY = "Smith Johnson Williams Brown Jones Miller Davis Wilson Taylor Clark Lewis Walker Young King Wright Baker Hill Green Adams Carter Fairweather Martinez Garcia Lopez Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Dubois Lefèvre Moreau Laurent Girard Kowalski Nowak Wójcik Ivanov Petrov Tanaka Sato Chen Wang Li Singh Khan Rossi Silva Santos O'Brien McDonald Jensen Larsen".split()
TITLES = "Mr Mrs Ms Miss Mr. Mrs. Ms. Dr Dr. Prof. Sir Herr Frau Mme M. Mlle Monsieur Madame Señor Señora Sr. Sra. Pan Pani".split()
ROADS = "Maple Oak High Church Station Victoria Park Mill River School Garden Forest Bahnhof Linden Schiller Goethe Garten Rosen Hauptmann Pasteur Molière Cervantes Mozart Elm Cedar".split()
ROAD_KINDS = "Street St Road Rd Avenue Ave Lane Ln Drive Dr Close Row Court Way Place Square Terrace Crescent Gardens Mews Hill".split()
ROAD_ENDS = ["straße", "strasse", "str.", "gasse", "weg", "allee", "platz", "ring", "ufer", "damm"]
ROAD_STARTS = ["rue du", "rue de la", "rue", "avenue", "boulevard", "place", "chemin", "impasse", "allée", "calle", "avenida", "plaza", "paseo", "rua", "travessa", "ul.", "aleja", "via", "viale"]
PLACES = "London Leeds Bristol Boston Denver Austin Köln Bremen Kassel Leipzig Wien Bern Lyon Nantes Lille Nice Sevilla Bilbao Porto Braga Kraków Gdańsk Torino Verona Riverton Springfield".split()
NOUNS = "table window garden letter report bottle engine picture coffee bridge market river story summer teacher music doctor winter paper camera ticket kitchen dinner farmer driver forest problem question answer budget contract meeting sample signal sensor server module vector pointer branch commit release folder button layout screen battery pencil basket jacket mirror blanket tunnel harbor castle sugar butter orange lemon copper silver marble".split()
VERBS = "opened closed moved cleaned bought sold painted found lost fixed checked shipped loaded parsed merged cooked planted wrapped counted answered repaired drew lifted washed built tested sent kept".split()
ADJ = "green quiet heavy small bright broken early modern simple famous cheap narrow empty final public second gentle wide rapid sweet bitter plain spare loose thick daily".split()
PAIRS = ["New York", "San Francisco", "Los Angeles", "Microsoft Windows", "Visual Studio", "Google Maps", "United Kingdom", "South Africa", "Monday Morning", "Chapter Two", "Part One", "Red Cross", "World Cup", "Great Lakes", "North Sea", "Black Forest", "Open Source", "Machine Learning", "Annual Report", "Terms of Service", "User Guide", "Human Resources", "Star Wars", "Christmas Eve"]
FIRMS = "Ltd Inc GmbH AG SA Bakery Store Shop Market Works Motors Pharmacy Books Café Industries Services Systems Bank Hotel Press Labs Group Studio Foods".split()
CAPITALISED = "Projekt Rechnung Küche Bericht Woche Vertrag Schlüssel Straße Wörter Zeile Änderung Übersicht Tabelle Fenster Büro Prüfung Lösung Größe".split()
TLDS = ["com", "org", "net", "edu", "io", "co.uk", "de", "fr", "es", "pl", "example", "test", "invalid", "info"]
COMMON_DOCS = ["passport", "identity card", "driving licence", "driver's licence", "tax ID", "insurance number", "social security number", "national ID", "national identity number", "ID card", "Steuer-ID", "Personalausweis", "numéro de passeport"]
WARES = "order part book tracking invoice receipt ticket batch serial model lot shipment catalogue bill item article delivery Rechnung Bestellung commande facture pedido".split()
DOCS = ["passport", "passport number", "ID card", "identity document", "national ID", "driving licence", "driver license", "social security", "SSN", "tax number", "tax id", "taxpayer number", "health insurance number", "insurance number", "residence permit", "Reisepass", "Reisepassnummer", "Ausweis", "Ausweisnummer", "Personalausweis", "Führerschein", "Steuernummer", "Steuer-ID", "Sozialversicherungsnummer", "passeport", "numéro de passeport", "carte d'identité", "permis de conduire", "numéro de sécurité sociale", "numéro fiscal", "pasaporte", "DNI", "NIE", "driver's licence", "identity card", "identity number", "social security number", "CPF", "passaporte", "PESEL", "dowód osobisty"]

LEADS = {
    "email": ["you can reach me under ", "questions go to ", "my address is ", "email ", "Email: ", "Mail: ", "e-mail me at ", "please write to ", "write to ", "mail ", "forward the {n} to ", "invoices should be sent to ", "notify ", "From: ", "To: ", "Bcc: ", "user=", "login ", "account=", "mail=", "address={d2}&email=", "Rückfragen an ", "Schreiben Sie an ", "Antworten bitte an ", "Mail an ", "contactez ", "envoyez un message à ", "courriel : ", "escriba a ", "correo: ", "escreva para ", "napisz do ", "signed by <", "sent from <", "approved via ", "the {n} came from ", "a note for ", "mailto:", "MATMSG:TO:", "EMAIL:", "EMAIL;TYPE=HOME:", "", "- ", "maintainer ", "copy to ", "if you see the {n}, tell ", "at ", "by "],
    "phone": ["phone ", "Phone: ", "phone: ", "ring me on ", "ring ", "you can call ", "call me on ", "call ", "dial ", "fax number ", "fax ", "fax: ", "text ", "text us at ", "send a text to ", "SMS to ", "mobile ", "my mobile number is ", "my cell is ", "mobile is ", "his number is ", "cell: ", "tel ", "Tel: ", "T: ", "Tel.: ", "tel. ", "number=", "tel=", "mobile=", "reach the office on ", "Handy ", "Telefonnummer ", "Telefon ", "erreichbar unter ", "bitte anrufen unter ", "Mobilnummer: ", "Nummer ", "téléphone ", "Tél. : ", "appelez le ", "portable : ", "au numéro ", "joignable au ", "llame al ", "teléfono ", "móvil ", "ligue para ", "telefone: ", "zadzwoń pod ", "WhatsApp: ", "Signal ", "call or text ", "hotline ", "emergency contact ", "tel:", "sms:", "smsto:", "SMSTO:", "TEL:", "TEL;TYPE=WORK:", "TEL;TYPE=HOME,VOICE:", ""],
    "id_number": ["{doc}: ", "{Doc}: ", "{doc} ", "{Doc} ", "{doc} no. ", "{doc} No. ", "{doc} no. ", "with {doc} no. ", "{doc} no.: ", "{doc} number ", "{doc} nr ", "{Doc}-Nr. ", "{Doc} Nr. ", "{Doc} n° ", "{doc} : ", "{Doc} : ", "{doc} # ", "{doc} is ", "his {doc} is ", "her {doc} ", "the {doc} reads ", "the {doc} of the driver is ", "the {doc} in the file reads ", "scanned {doc} (", "holder of {doc} ", "copy of the {doc} (", "valid {doc}: ", "checked the {doc} ", "issued {doc} ", "compared with {doc} ", "{doc}=", "{DOC}: ", "no {doc} but "],
    "street_address": ["address ", "Address: ", "address: ", "lives in ", "resident at ", "living at ", "moved from ", "moved to ", "we met at ", "our house is ", "send the {n} to ", "pick it up at ", "bring the {n} to ", "billing address: ", "postal address ", "located at ", "Adresse: ", "Adresse ", "wohnt ", "wohnhaft in der ", "Lieferadresse ", "Sitz: ", "habite ", "adresse : ", "domicilié ", "siège : ", "vive en ", "domicilio: ", "dirección: ", "mora na ", "morada: ", "mieszka przy ", "deliver to ", "visit ", "come to ", "at ", "to: ", "ADR:;;", "ADR;TYPE=HOME:;;", "", "from ", "back to ", "the {n} is at "],
    "person_name": ["by ", "from ", "with ", "to ", "for ", "Dear ", "Hello ", "Hi ", "Kind regards, ", "Signed, ", "signed by ", "written by ", "written by: ", "author ", "Author - ", "Owner: ", "assigned to ", "reviewed by ", "noted by ", "taken by ", "approved by (", "seen (", "contact person: ", "attn. ", "c/o ", "patient: ", "Name: ", "name=", "customer ", "thanks to ", "spoke to ", "met ", "tell ", "meeting with ", "the {n} of ", "the {n} was sold to ", "Ansprechpartner: ", "Sehr geehrte ", "Liebe ", "von ", "mit ", "für ", "gez. ", "Name: ", "verantwortlich ist ", "de la part de ", "avec ", "remis à ", "Cher ", "Chère ", "auteur : ", "signé ", "Estimado ", "firmado por ", "con ", "para ", "assinado por ", "autor: ", "FN:", "", "", "", "", "", "", "- ", "Badge ", "guest: ", "please ask ", "as told by ", "ask for ", "is owned by ", "owned by ", "in the room of ", "and "],
}
TAILS = {
    "email": ["", "", ".", ", please.", " before noon.", " about the {n}.", " as soon as you can.", " or come by.", "?subject={w}", ";SUB:{w};;", ";;", ">", "> on Friday.", ">.", "; {n}={w}", " for the {n}, not the desk.", ", thanks", " heute noch.", " avant jeudi.", " (work)", " {Adj} {n}s were {v}.", "&id={d3}", ")"],
    "phone": ["", "", ".", ", please.", " before noon.", " about the {n}.", " after six.", " or come by.", ":the {n} is ready", ";;", " ({n})", ", evenings.", ", werktags.", " le soir.", " (work)", " The {n} was {v}.", ", then bring the {n}.", " if the {n} is {adj}.", ")"],
    "id_number": ["", "", ".", ", expires 20{d2}", " today.", ")", ") today.", ") is with the {n}.", " was written on the {n}.", " was seen by the {n} team", " is the one we had", " {v} the {n} list", " at the counter.", "; room {d2}", "; {n} {d1}", " is on record.", " wurde geprüft.", " a été vérifié.", " The {n} was {v}."],
    "street_address": ["", "", ".", ", please.", " with the {n}.", " since May.", " today.", "; the {n} too.", " (back door)", " The {n} was {v}.", ";;", " seit Mai.", " depuis mars.", ", second floor", ", and ring twice."],
    "person_name": ["", "", "", ".", ",", " said so.", " agreed to come.", " will pay.", " has the key.", " called yesterday.", " took the {n}.", " received the {n}.", " opened the {n} for us.", " signed the {n}.", " never {v} the {n}.", " {v} it.", "'s desk", " and the team", " (owner)", ")", ") once the {n} was {v}.", ", manager", " kommt morgen.", " hat unterschrieben.", " a signé.", " firmó.", " {v} the {n}.", " that the {n} was {v}.", " to bring the {n}.", " for the {n}.", " The {n} was {v}.", " Nobody {v} the {adj} {n}.", ": the {n} is {adj}", "; room {d2}", "\n{W} {firm}", "\n{W} {firm}, hall {d1}", " {W} {firm}, hall {d1}"],
}
MIXED = [
    *["{plainname}"] * 20, *["{name}"] * 6, *["{doc} no. {id} {v} the {n}", "{doc} no. {id} was {v} on the {n}", "{Doc} no. {id} is {adj}"] * 2, "{W} {n}\n{plainname}\n{W} {firm}, gate {d1}", "{N}\n{name}\n{d5} {place}",
    "{name}, {address}, {email}, {phone}", "{name}\n{address}\n{phone}\n{email}", "BEGIN:VCARD\nVERSION:3.0\nN:{cardname};;;\nFN:{plainname}\nTEL;TYPE=HOME:{phone}\nEMAIL:{email}\nEND:VCARD", "MECARD:N:{commaname};TEL:{phone};EMAIL:{email};;", "MECARD:N:{commaname};;", "N:{cardname};;;", "N:{commaname};;",
    "call {name} at {phone} or write to {email}", "{name} ({email}) {v} the {n}", "{name}, {doc}: {id}", "{doc}: {id}, phone {phone}", "{address}, phone: {phone}", "write to {email} or {email}", "{name} and {name} met {name}.", "upi://pay?pa={handle}@ok{w}&pn={linkname}&am={d3}", "upi://pay?pa={handle}@ok{w}&pn={linkname}&am={d2}", "upi://pay?pa={handle}@ok{w}&pn={linkname}&cu=INR", "upi://pay?pa={masked}@ok{w}&pn={linkname}&am={d3}", "upi://pay?pa={masked}@ok{w}&pn={linkname}", "upi://pay?pn={linkname}&pa={handle}@{w}", "pn={linkname}&am={d3}", "pa={masked}@ok{w}&pn={linkname}&am={d2}", "payee={handle}@{w}&pn={linkname}&am={d3}",
    "Contact {name} <{email}>", "{name}: {phone}", "https://{w}.example/?user={d3}&mail={pemail}", "https://{w}.test/{n}?to={pemail}&{w}=1", "ADR:;;{cardaddress};;{d5};", "{shout}, {doc} {id}", "by {shout}. The {n} was {v}.", "as {revname} said, the {n} was {v}.", "with {revname} in the {n}", "{revname}\n{email}",
]
PLAIN = [
    "The {n} {v} the {adj} {n}.", "The {adj} {n} was {v} by the {n} team on Friday.", "{N} and {n} {v} {d2} {n}s.", "We visited {pair} in June.", "It runs on {pair} as well.", "{pair} is {adj}.", "Project {Adj} {N} {v} the {n}.", "Operation {N} {N} ended.", "Project {W} {W} {v} the {n}.", "Project {W} {N} is {adj}.", "Project {Adj} {W} {v} a {n}.", "Release {W} {W} was {v}.", "Team {W} {N} met.", "Campaign {Adj} {N} ended in {place}.", "the {W} {N} plan", "{W} {W} Street Festival", "{W} Castle, {W} Bridge and {W} Park", "The {N} {N} committee met.", "{W} {firm} sells the {n}.", "{W} & {W} {firm} sell {n}s (since {d4}).", "{W} {firm}, hall {d1}", "{W} {firm}\n{W} {firm}, gate {d1}", "Order {d7} left {place} on Monday.", "order no. {d4}-{d4}", "tracking number {d4} {d4} {d4}", "Tracking {d4} {d4} {d4} {d2} arrived", "ISBN 978-{d1}-{d4}-{d4}-{d1} is the {n} guide.", "book number 979-{d1}-{d3}-{d5}-{d1}", "part no. {U}{d3}-{d4}-{d2} for the {n}", "Part {U}{d3}-{d4}-{d4} and part {U}{d2}-{d4}", "Part {U}{d3}-{d4}-{d4} {v} the {n}.", "part {U}{d2}-{d4}-{d3}", "Spare {U}{d3}-{d4}-{d4} was {v}.", "serial {U}{U}{d6}{U}", "SKU {d6}-{d3}", "asset {d3}-{d2}-{d4}", "invoice {d3}-{d2}-{d4} is open", "Case #{d7} was closed at {t}.", "batch {d7}{d4}", "{d7}{d6}", "{d3} {d3} {d3}", "{Adj} {n} {d3} {d3}", "{N} {d2} {d3}, {n} {d3}",
    "npm i {w}@{d1}.{d2}.{d1}", "{w}=={d1}.{d1}.{d2}", "uses {w}@{d1}.{d1} for the {n}", "{w}@v{d1} and {n}@{d1}.{d1}.{d1} are pinned", "git clone git@{w}.example:{w}/{n}.git", "ssh://git@{w}.example/{n}.git is the remote", "git@{w}.test:team/{n}.git", "ask in @{w} on the chat", "ping @{w}{n} or @{n}-{w} there", "the @{w} channel", "host {ip} answered in {d3} ms", "the node at {ip} is down", "from {ip} to {ip}", "server {ip}:{d4} {v} the {n}", "{ip}", "A {adj} {n} and {d2} {n}s were {v}.", "{N} and {n} belong to the {adj} {n}.", "On {day}, the {n} was {v}.", "Last {day} the {n} was {v}.", "Each {day}, a {adj} {n} gets {v}.", "{ware} no. {code}", "{Ware} no. {code} is {adj}.", "{Ware} No. {code} for the {n}", "{Ware} number {code} was {v}.", "{ware}: {code}", "{Ware} {code} {v} the {n}", "{Ware} no. {code} {v} it.", "{ware} # {code} is here", "{ware} code {code}, {n} {d2}", "{Ware} ({code})", "The {n} looked {adj}, so we {v} another {n} there.", "at {d2}.{d5}, {d2}.{d5} on the map", "[{t}] warn {w}/{n} slow ({d3} ms)", "20{d2}-0{d1}-1{d1}T{t}Z INFO {w}: id={w} {n} {v}", "20{d2}-0{d1}-1{d1} {t} ERROR {w} {d6} {n} not found", "def {v}_{n}({w}, {n}={d2}):", "func {v}{N}({n} []string) (map[string]int, error) {{", "return {W}Error(\"{n} {adj}\")", "import {{ {W}{N}, {N} }} from '{w}/{n}';", "class {W}{N}({N}):", "SELECT {n}, count(*) FROM {w} WHERE {n}_id > {d3}", "const {n} = new {W}{N}({d2}, '{w}');", "if ({n} < {d2} && {w} >= {d3}) {{", "C:\\{N}\\{W}\\{n}.txt", "/home/{w}/{n}/{d3}.log", "https://{w}.example/{n}/{d7}{d3}", "https://{w}.test/{n}?id={d6}", "bitcoin:{hash}?amount=0.{d2}", "litecoin:{hash}?amount={d1}.{d2}", "ethereum:{hash}", "commit {hash} {v} the {n}", "{hash}", "WIFI:S:{n}_{w};T:WPA;P:{w}{d3};;", "WIFI:S:{n}_{w};T:WPA;P:***;;", "000201{d7}{d7}{d7}{W}{d7}{d5}",
    "upi://pay?pa={handle}@ok{w}&pn={W}%20{firm}&am={d3}", "upi://pay?pa={handle}@ok{w}&pn={W} {firm}&cu=INR", "upi://pay?pa={masked}@ok{w}&pn={W}%20{firm}", "pay {handle}@ok{w}", "BEGIN:VCARD", "VERSION:3.0", "END:VCARD", "Monday to Friday, {t} to {t}", "See {N} {N}, Part {d1}, page {d3}.", "{N} {d1}: {N} {N}", "Shelf {d2}, row {d1}, {place} depot", "Room {d3}, floor {d1}, {place} branch", "gate {d1}, {place}", "{place} to {place} takes {d3} minutes.", "${d2} for the {n} and ${d3} for two {n}s", "table {d1}  {d2}  {d3}  {d4}", "The {doc} counter is {adj}.", "A {doc} with {d3} pages.", "The {doc} {d3} was lost on Monday.", "Phone the {n} team about the {adj} {n}.", "Call the {n} back later.", "email the {n} list", "the address of the {n}", "Author: the {n} team", "Owner", "Name", "Contact: the front desk",
    "Im {K} haben wir die {K} und den {K} geprüft.", "Die {K} liegt im {K} neben der {K}.", "Für {K} und {K} gibt es {d3} {K}.", "Am Montag wurde der {K} geändert.", "Ohne {adj}e {K} kann die {K} nicht {w}.", "Nach der {K} wurden {K} und {K} geprüft.", "Alle {K} der {K} sind {adj}.", "Le {n} numéro {d3} est {adj} à côté du {n}.", "L’été dernier, la {n} était fermée.", "Voilà pourquoi le {n} reste {adj}.", "El {n} número {d3} no llegó.", "O {n} foi {adj} na segunda.", "Gdzie jest {n} z {d3} strony?", "Someone {v} {d2} pages of the {n}.", "If the {n} is {adj}, the {n} gets {v}.", "Most {adj} {n}s were {v} at the {n}.", "After two {n}s, the {adj} {n} was {v}.", "Once {v}, a {n} stays {adj} for {d2} days.", "Without a {adj} {n} the {w} step stays {adj}.", "Two {n}s and a {adj} {n} were {v} in the {n} on Tuesday.", "Neither the {n} nor the {n} was {adj}.", "They {v} it; he said the {n} is {adj}.", "See https://{w}.example/{n} for the {n}.", "TODO: {v} the {n} ({w})", "- {n}: {d2}\n- {n}: {d3}", "# {N} {n}\nThe {n} was {v}.", "| {n} | {d3} | {adj} |", "{N} {n} {v} {adj} {n}", "HTTP/1.1 {d3} {N} {N}", "At the {N} Office, a {n} and {d2} {n}s were {v}.",
]
#: Frames that aren't trained on.
HELD_OUT = [
    "The courier left it with {name} around noon.", "Beneficiary {name}, born in May.", "My sister's e-mail has changed: {email}", "Complaints? {email} answers within a day.", "Der Vermieter {name} ist im Urlaub.", "La facture a été payée par {name}.", "Our new number: {phone}.", "Wrong number? It is {phone} since March.", "He rents a flat, {address}, with a cat.", "The shop closed; it used to be at {address}.", "Applicant {name} ({doc} {id}) appeared.", "Verified by {doc} {id} and a photo.",
    "{pair} hosted the fair.", "The {W} {firm} opened a branch.", "Parcel number {d4} {d4} {d4} is late.", "The lock file says {w}@{d1}.{d2}.{d1}.", "Push to git@{w}.example:{n}/{w}.git today.", "Spare part {U}{d3}-{d4}-{d4} is in stock.", "Invoice {d3}-{d2}-{d4} was paid twice.", "Who runs the @{w} group?",
]
_ONSETS, _NUCLEI, _CODAS = "b bl br c ch cl cr d dr f fl fr g gl gr h j k kl kn l m n p ph pl pr qu r s sch sh sk sl sn sp st str t th tr v w wh y z zw".split(), "a e i o u ai au ea ee ei ia ie oa oo ou ue y".split(), "b ch ck d f g k l ld lf lm m mp n nd ng nt p r rb rd rm rn rs rt s sh sk st t th v w x z".split()


class _Fill:
    def __init__(self, rng: random.Random):
        self.r = rng

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def word(self) -> str:
        c = self.r.choice
        return "".join(c(_ONSETS) + c(_NUCLEI) for _ in range(self.r.randint(1, 2))) + c(_CODAS)

    def given(self) -> str:
        return self.r.choice(GIVEN) if self.r.random() < 0.3 else self.word().capitalize() + self.r.choice(["", "", "a", "e", "ine", "us", "ia", "el"])

    def family(self) -> str:
        f = self.r.choice(FAMILY) if self.r.random() < 0.25 else self.word().capitalize() + self.r.choice(["", "", "", "er", "son", "sen", "ini", "ov", "ski", "mann", "ard", "ez", "ley", "ton", "ak"])
        return f if self.r.random() < 0.94 else f"{f}-{self.r.choice(FAMILY)}"

    def place(self) -> str:
        return self.r.choice(PLACES) if self.r.random() < 0.5 else self.word().capitalize() + self.r.choice(["ton", "ville", "burg", "au", "by", ""])

    def local(self) -> str:
        g, f, c = self.r.choice(GIVEN).lower() if self.r.random() < 0.5 else self.word(), self.family().lower().replace("'", ""), self.r.choice
        return c([f"{g}.{f}", f"{f}.{g}", f"{g}{f}", f"{g[0]}.{f}", f"{g[0]}{f}", f"{f}-{g}", f"{g}_{f}", f"{g}{self.digits(self.r.randint(1, 4))}", f"{g}_{f[0]}", f, f"{g}.{f}+{c(NOUNS)}", f"{c(NOUNS)}-{g}"])

    def host(self) -> str:
        c = self.r.choice
        name = c([self.word(), c(NOUNS), self.word() + c(["mail", "net", "post"]), f"{self.word()}.{c(NOUNS)}", f"{c(['mail', 'office', 'inbox', 'post', 'home'])}.{self.word()}", f"{c(NOUNS)}-{self.word()}"])
        return f"{name}.{c(TLDS)}"

    def email(self) -> str:
        local, host, form = self.local(), self.host(), self.r.random()
        if form < 0.7:
            out = f"{local}@{host}"
        elif form < 0.8:
            out = f"{local}{self.r.choice(['(at)', '[at]', '{at}', ' (at) '])}{host}"
        elif form < 0.94:
            at, dot = self.r.choice([(" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)"), (" (at) ", " (dot) ")])
            out = f"{local}{at}{host.replace('.', dot)}"
        else:
            out = f"{local.replace('+', '%2B')}%40{host}"
        return out.upper() if self.r.random() < 0.12 else out

    def groups(self, sizes: list[int], seps: list[str]) -> str:
        sep = self.r.choice(seps)
        return sep.join(self.digits(n) for n in sizes)

    def phone(self) -> str:
        """An optional country part, an optional area part, groups of digits: 7 to 14 digits."""
        r, c = self.r, self.r.choice
        kind = r.random()
        if kind < 0.12:
            return c(["+", "00", ""]) + self.digits(r.randint(9, 13))
        sizes = c([[3, 4], [3, 3, 3], [4, 4], [2, 2, 2, 2], [3, 3, 4], [3, 4, 4], [2, 3, 2, 2], [3, 2, 2], [6], [7], [4, 3, 3], [2, 4, 4], [5, 6], [3, 3, 2, 2]])
        country = c(["", "", f"+{self.digits(r.randint(1, 3))}", f"00{self.digits(2)}", "0"])
        area = c(["", f"({self.digits(r.randint(2, 4))})", f"(0{self.digits(r.randint(2, 3))})", f"0{self.digits(r.randint(2, 3))}/", f"0{self.digits(2)} "])
        sep = c([" ", " ", "-", ".", "-", ""]) if len(sizes) < 5 else " "
        body = sep.join(self.digits(n) for n in sizes)
        glue = c([" ", "-", " ", ""]) if country else ""
        out = country + glue + area + (c([" ", " ", ""]) if area.endswith(")") else "") + body
        if sum(x.isdigit() for x in out) < 7:
            out = f"+{self.digits(2)} {self.digits(3)} {out}"
        return out + (c([" ext. ", " x", " ext "]) + self.digits(r.randint(2, 4)) if r.random() < 0.07 else "")

    def idno(self) -> str:
        r = self.r
        letters = "".join(r.choice("ABCDEFGHKLMNPRSTXYZ") for _ in range(r.choice([0, 0, 1, 1, 2, 2, 3])))
        end = r.choice("ABCDEFGHKLMNPRSTXYZ") if r.random() < 0.3 else ""
        sizes = r.choice([[6], [7], [8], [9], [10], [11], [3, 3], [3, 2, 4], [2, 3, 3, 3], [4, 4], [3, 4, 4], [6, 4], [2, 2, 2], [2, 2, 4], [3, 3, 3], [6, 2], [2, 2, 2, 2]])
        sep = r.choice([" ", "-", "-", ".", " "])
        return letters + (sep if letters and r.random() < 0.4 else "") + sep.join(self.digits(n) for n in sizes) + (r.choice([sep, ""]) + end if end else "")

    def address(self) -> str:
        r, c = self.r, self.r.choice
        road = c(ROADS) if r.random() < 0.4 else self.word().capitalize() + c(["", "er", "en", "wood", "gate", "field"])
        n = str(r.randint(1, 250)) + c(["", "", "", "", c("abcd"), c("ABCDE"), c("ABCDE"), "/2", "-4"])
        post = c([self.digits(5), self.digits(4), f"{self.digits(2)}-{self.digits(3)}", f"{c('ABELMNSW')}{self.digits(1)} {self.digits(1)}{c('ABDEH')}{c('ABDEH')}"])
        town = c([f", {post} {self.place()}", f", {self.place()}", f", {self.place()} {post}", f" {self.place()} {post}", "", ""])
        flat = f"{c(['Flat', 'Apt', 'Apartment', 'Unit', 'No.'])} {r.randint(1, 60)}, " if r.random() < 0.12 else ""
        form = r.random()
        if form < 0.5:
            out = f"{n} {road} {c(ROAD_KINDS)}"
        elif form < 0.72:
            end = c(ROAD_ENDS)
            out = f"{road}{end} {n}" if r.random() < 0.8 else f"{road}er {end.capitalize()} {n}"
        else:
            start = c(ROAD_STARTS)
            out = c([f"{n}, {start} {road}", f"{n} {start} {road}", f"{start} {road} {n}", f"{start} {road}, {n}"])
        return flat + out + town

    def name(self) -> str:
        g, f, c = self.given(), self.family(), self.r.choice
        initial = c("ABCDEFGHJKLMNPRSTVW")
        return c([f"{g} {f}", f"{g} {f}", f"{g} {f}", f"{g} {f}", f"{f}, {g}", f"{g[0]}. {f}", f"{initial}. {f}", f"{g} {initial}. {f}", f"{initial}. {g} {f}", f"{g} {self.given()} {f}", f"{f} {initial}.", f"{c(TITLES)} {f}", f"{c(TITLES)} {f}", f"{c(TITLES)} {f}", f"{c(TITLES)} {f}", f"{c(TITLES)} {g} {f}", f"{f.upper()} {g}", f"{f.upper()} {g}", f"{f.upper()}, {g}"])

    def fill(self, frame: str) -> str:
        r, d, c = self.r, self.digits, self.r.choice
        tag = lambda kind, text: f"[[{kind}|{text}]]"
        g, f, doc = self.given(), self.family(), c(DOCS if r.random() < 0.4 else COMMON_DOCS)

        def value(m: re.Match) -> str:
            k = m.group(1)
            if re.fullmatch(r"d\d", k):
                return d(int(k[1]))
            w = self.word() if k in ("w", "W") else ""
            return {
                "n": lambda: c(NOUNS), "N": lambda: c(NOUNS).capitalize(), "adj": lambda: c(ADJ), "Adj": lambda: c(ADJ).capitalize(), "v": lambda: c(VERBS), "w": lambda: w, "W": lambda: w.capitalize(), "U": lambda: c("ABCDEKLMNPRSTXYZ"), "K": lambda: c(CAPITALISED),
                "pair": lambda: c(PAIRS), "firm": lambda: c(FIRMS), "place": self.place, "hash": lambda: "".join(c("0123456789abcdefghjkmnpqrstuvwxyz") for _ in range(r.randint(16, 34))), "ware": lambda: c(WARES), "Ware": lambda: c(WARES).capitalize(), "code": self.idno, "day": lambda: c("Monday Tuesday Wednesday Thursday Friday Saturday Sunday June March Spring Autumn".split()), "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), "t": lambda: f"{r.randint(0, 2)}{r.randint(0, 3)}:{r.randint(10, 59)}:{r.randint(10, 59)}", "doc": lambda: c([doc, doc.lower()]), "Doc": lambda: doc[0].upper() + doc[1:], "DOC": lambda: doc.upper(),
                "email": lambda: tag("email", self.email()), "pemail": lambda: tag("email", self.local().replace("+", "%2B") + "%40" + self.host()), "phone": lambda: tag("phone", self.phone()), "id": lambda: tag("id_number", self.idno()), "address": lambda: tag("street_address", self.address()), "name": lambda: tag("person_name", self.name()),
                "cardname": lambda: tag("person_name", f"{f};{g}"), "commaname": lambda: tag("person_name", f"{f},{g}"), "plainname": lambda: tag("person_name", f"{g} {f}"), "revname": lambda: tag("person_name", f"{f}, {g}"), "shout": lambda: tag("person_name", f"{f.upper()} {g}"), "linkname": lambda: tag("person_name", g + c(["+", "%20", " "]) + f), "cardaddress": lambda: tag("street_address", f"{r.randint(1, 99)} {c(ROADS)} {c(ROAD_KINDS)}") + f";{self.place()}",
                "handle": lambda: c([f"{g}{f}", f"{g}.{f}", f"{f}{d(2)}", self.word() + c(NOUNS)]).lower(), "masked": lambda: f"{g[:2].lower()}***{f[-1]}",
            }[k]()

        return re.sub(r"\{(\w+)\}", value, frame.replace("{{", "\x00").replace("}}", "\x01")).replace("\x00", "{").replace("\x01", "}")


#: Rows of each lead.
PER_LEAD = {"email": 11, "phone": 14, "id_number": 46, "street_address": 13, "person_name": 18}
_SLOT = {"email": "{email}", "phone": "{phone}", "id_number": "{id}", "street_address": "{address}", "person_name": "{name}"}
_BEFORE = ["", "", "", "", "", "// ", "# ", "-- ", "* ", "> ", "[{t}] info ", "20{d2}-0{d1}-1{d1}T{t}Z DEBUG {w}: ", "20{d2}-0{d1}-1{d1} {t} WARN ", "{N} "]


def _shouted(row: str) -> str:
    return "".join(x if x in ("[[", "]]") or x.endswith("|") else x.upper() for x in re.split(r"(\[\[|[a-z_]+\||\]\])", row))


def labelled_table(share: float = 1.0, per_frame: int = 22, seed: int = 11) -> list[str]:
    """About 9,000 labelled texts."""
    fill = _Fill(random.Random(seed))
    r, rows = fill.r, []
    for kind, leads in LEADS.items():
        for lead in leads:
            for k in range(round(PER_LEAD[kind] * share)):
                first = lead[:1].upper() + lead[1:] if k % 2 else lead
                frame = first + _SLOT[kind] + r.choice(TAILS[kind])
                if k % 5 == 4:  # in the middle of running text
                    frame = f"{r.choice(PLAIN)} {frame}" if r.random() < 0.5 else f"{frame} {r.choice(PLAIN)}"
                rows.append(frame)
    rows += [frame for frame in MIXED for _ in range(per_frame)] + [frame for frame in PLAIN for _ in range(per_frame)]
    out = []
    for k, frame in enumerate(rows):
        s = fill.fill(r.choice(_BEFORE) + frame)
        out.append(_shouted(s) if k % 9 == 8 else s)
    return out


def held_out(per_frame: int = 10, seed: int = 5) -> list[str]:
    """Labelled texts in frames that the training table doesn't have."""
    fill = _Fill(random.Random(seed))
    return [fill.fill(frame) for frame in HELD_OUT for _ in range(per_frame)]
