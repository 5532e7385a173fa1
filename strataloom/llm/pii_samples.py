"""The small labelled table of the field for personal information.

Each row is a line of text with the spans of its mentions, known because the line is put together here: values of each
type by the grammars in which people write them, in sentences, rows and fields of five languages, or dropped into lines
of the corpus that can hold none. As many things that only look like a mention are put in beside them, unlabelled.
"""

from __future__ import annotations

import random
import re

# Words of the generated lines.
_STREETS_EN = ["Street", "Road", "Lane", "Avenue", "Ave", "Close", "St", "St.", "Rd", "Rd.", "Ln", "Drive", "Way", "Court", "Terrace", "Square", "Crescent", "Boulevard", "Blvd", "Place", "Hill", "Gardens"]
_STREETS_DE = ["straße", "strasse", "gasse", "weg", "platz", "allee", "ufer", "ring", "damm", "steig"]
_STREETS_FR = ["rue", "avenue", "boulevard", "place", "chemin", "allée", "quai", "impasse", "route", "cours"]
_STREETS_ES = ["Calle", "Avenida", "Plaza", "Paseo", "Camino", "Carrera", "Ronda", "Travesía"]
_STREETS_ZH = ["路", "街", "大道", "巷"]
_PLACE_ZH = "江云山东南西北新长安平海河湖林花石金玉龙凤春秋明阳光华兴和宁永福泉清古松柏桥门城塘溪岭竹梅兰月星"
_TLDS = ["com", "org", "net", "de", "fr", "es", "cn", "io", "co.uk", "eu", "edu", "example", "test", "invalid", "info"]
_TITLES = ["Dr. ", "Mr. ", "Ms. ", "Mrs ", "Prof. ", "Frau ", "Herr ", "Mme ", "M. ", "Sr. ", "Sra. ", "Dra. "]
_STARTS = ["Yesterday ", "Today ", "Later ", "When ", "Then ", "Maybe ", "Meanwhile ", "Only ", "After that ", "Gestern haben ", "Heute war ", "Hier ", "Puis ", "Ayer ", "Hoy ", "Our ", "That ", "With ", "Once "]
_LABELS = {
    "email": ["Email: ", "e-mail ", "E-Mail: ", "mailto:", "Kontakt: ", "contact: ", "Correo: ", "Courriel : ", "邮箱：", "From: <", "cc ", "reach me at ", "write to ", "escribir a ", "écrire à ", "# maintainer: ", "owner=", "by "],
    "phone": ["Tel: ", "tel:", "Phone ", "phone: ", "call ", "Call ", "text ", "ring ", "Telefon ", "unter ", "Tél. ", "teléfono ", "电话是", "致电", "mobile ", "fax: ", "dial ", "/ ", "On-call: "],
    "identity_number": ["SSN ", "SSN: ", "National id ", "tax id: ", "Tax ID ", "Passport ", "passport no. ", "Staff number ", "employee no ", "Ausweis ", "Steuer-ID ", "Documento ", "DNI ", "pièce d'identité ", "证件号", "工号", "护照", "has number ", "badge ", "file ("],
    "street_address": ["address: ", "Address: ", "home: ", "lives at ", "moved to ", "Ship to ", "Deliver to ", "board to ", "to ", "Adresse: ", "wohnt in der ", "an ", "adresse : ", "part pour ", "dirección: ", "va a ", "地址：", "住址", "寄到", "office at ", "noon, ", "* ", "desk: "],
    "person_name": ["Contact ", "Ask ", "From: ", "To: ", "Signed: ", "signed by ", "thanks, ", "Regards, ", "Reviewed by ", "Ticket of ", "on behalf of ", "Rückfragen an ", "Ansprechpartner ", "Merci à ", "contacter ", "Escriba a ", "firmado por ", "联系人 ", "由", "cc ", "owner: ", "names ", "- [ ] ", "author = ", "/* ", "and ", "Old desk of "],
}
_AFTER = ["", ".", ",", ";", ":", ")", ">", " |", "。", "，", "?", "\"", "'", " and so on", " for details.", " before noon", " last week", " now", " */", " (see above)", " left the room", " took over.", "'s desk", " über", " 的", " 已登记。", ", thanks", " /"]
_SENTENCES = [
    "{N} <{E}>", "From: {N} <{E}>", "{N}, {P}", "Signed: {N}, {I}", "On-call: {N} / {P}", "Please call {P} or write to {E} before the window closes", "Contact {N} ({E}) or {P}.",
    "{N}, reach them at {E}.", "Ticket opened by {E} on behalf of {N}", "{\"contact\": \"{E}\", \"tel\": \"{P}\"}", "| {N} | {P} | {E} |", "{N};{E};{P};{A}", "SSN {I} / phone {P}", "National id {I}; home: {A}, {C} {Z}",
    "His file ({I}) names {N} as owner.", "The badge of {N} has number {I}.", "Our lab moved to {A}, {C} {Z} last week.", "Visitor address: {A} (ring {P})", "Ship the board to {A}, {C} {Z}.", "{A}, {Z} {C}",
    "Bitte senden Sie das Paket an {A}, {Z} {C}.", "Rückfragen an {N} unter {P}.", "Merci d'écrire à {N}, {E}.", "Le colis part pour {A}, {Z} {C}.", "El envío va a {A}, {Z} {C}. Escriba a {E}.", "Documento {I} de {N}.",
    "请联系{E}或致电{P}。", "{N} 的电话是{P}，住址{A}。", "证件号{I}已登记。", "设备寄到{A}，联系人 {N}。", "工号{I}，抄送{E}", "Passport {I} was copied. {T}{N} signed the report.", "{N} left the room and {N} took over.", "cc {N}; {N}; {N}",
    "Deliver before noon, {A} cc {N}; {G}", "Ask {N} about it, not {G}.", "{T}{F} met {N}.", "{G} and {N} agreed; {F} did not.", "thanks,\n{N}\n{P}", "name,mail\n{N},{E}", "Dear {G}, {N} will call {P}.", "Staff: {F}, {GF}", "with {F}, {N} and {G}",
    "with {F}, {GF} and {G}", "{N} ({I}, {P}, {E})", "tel: {P}, fax: {P}", "{E}, {E}; {E}", "{A}\n{Z} {C}\n{P}", "{X} {N} {X}", "{P} {X}", "{X} {I}", "Tel. {P} - {X}", "{X}, see {X}; {N}", "{W}{N} and {N} paired on it.", "{W}{N} left.", "{W}{T}{N} signed the report.", "{T}{N} signed it.", "{T}{N}, {P}", "{W}{G} and {N} spoke.", "{W}{F} and {F} agreed.", "tel:{P}", "SSN:{I}", "reach={P};mail={E}", "{X} is only a name", "{W}{X}", "{T}{F} asked {G}.", "{W}{T}{F} left.", "{T}{F}: {X}", "{T}{F} and {T}{F} spoke to {N}.",
]

_UNSAFE = re.compile(r"@|(?i:\bat\b|\bdot\b)|\d[\d\s./()+-]{3,}\d|[路街道巷号]|(?i:street|road|lane|avenue|\bave\b|close|\brd\b|\bst\b|stra(?:ß|ss)e|gasse|weg\b|platz|allee|\brue\b|chemin|quai|calle|avenida|plaza|paseo|camino)|[A-Z]\d[A-Z]\d|[A-Z]{2}[ -]?\d{4}|[A-Z]-\d{5}")


def safe_carrier(line: str, known: frozenset[str]) -> bool:
    """Whether a line can hold no mention: nothing that any type needs is in it, however it is written."""
    return not _UNSAFE.search(line) and known.isdisjoint(re.findall(r"[^\W\d_]+", line.lower()))


class Maker:
    """Values of each type and what looks like them. All that is random comes from ``seed``."""

    def __init__(self, given: list[str], family: list[str], seed: int):
        self.r = random.Random(seed)
        self.given, self.family = given or ["anna", "peter"], family or ["miller", "brown"]
        # Words of the family names' and the given names' own beginnings and ends, and others, so that a name needn't be known.
        self.ends = sorted({n[-k:] for n in self.given + self.family for k in (3, 4) if len(n) > k + 2}) or ["son"]

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def filled(self, form: str) -> str:
        """``form`` with each d a digit and each A a letter."""
        return "".join(self.digits(1) if c == "d" else self.r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") if c == "A" else c for c in form)

    def word(self) -> str:
        r = self.r
        return "".join(r.choice(["b", "br", "d", "f", "g", "gr", "h", "k", "l", "m", "n", "p", "qu", "r", "s", "st", "t", "v", "w", "z"]) + r.choice("aeiou") for _ in range(r.randint(1, 3))) + r.choice(["n", "r", "l", "m", "", "s", "th"])

    def one_name(self, kind: str) -> str:
        names = self.given if kind == "given" else self.family
        name = self.r.choice(names)
        if self.r.random() < 0.25:  # a name that the lexicon hasn't: another beginning or another end
            name = self.word() + name[-self.r.randint(3, 5) :] if self.r.random() < 0.5 else name[: self.r.randint(3, 5)] + self.r.choice(self.ends)
        return name.capitalize()

    def person_name(self) -> str:
        r = self.r
        g, f = self.one_name("given"), self.one_name("family")
        if r.random() < 0.08:
            f += "-" + self.one_name("family")
        name = r.choices([f"{g} {f}", f"{g} {r.choice('ABCDEFGHIJKLMNOPRSTUVW')}. {f}", f"{f}, {g}", f"{f}, {g} {r.choice('ABCDEFLMNT')}.", f"{g[0]}. {f}", f"{g}  {f}"], [50, 12, 18, 3, 14, 3])[0]
        return r.choices([name, name.upper(), name.lower()], [82, 9, 9])[0] if name[1] != "." else name

    def email(self) -> str:
        r = self.r
        g, f = self.one_name("given").lower(), self.one_name("family").lower()
        local = r.choice([f"{g}.{f}", f"{g}_{f}", f"{g}-{f}", f"{g[0]}{f}", f"{f}{g[0]}", f"{f}_{g[0]}", f"{g}{r.randint(1, 99)}", f"{f}", f"{self.word()}{r.randint(1, 999)}", f"{self.word()}.{self.word()}", ".".join(self.word() for _ in range(r.randint(3, 12))), "info", "support"])
        if r.random() < 0.15:
            local += "+" + self.word()
        labels = [self.word() if r.random() < 0.5 else r.choice(["mail", "example", "corp", "post", "lists", "ops", "dev", "web"]) for _ in range(r.choice([1, 1, 1, 2, 2, 3]))] + [r.choice(_TLDS)]
        if r.random() < 0.1:
            labels[0] += "-" + self.word()
        at, dot = r.choices([("@", "."), (" (at) ", " (dot) "), (" AT ", " DOT "), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)"), (" (at) ", ".")], [72, 7, 7, 4, 5, 3, 2])[0]
        mail = local + at + dot.join(".".join(labels).split("."))
        return mail.upper() if r.random() < 0.06 and at == "@" else mail

    def phone(self) -> str:
        r = self.r
        sep = r.choice([" ", " ", "-", "."])
        form = r.choices(
            [f"+{r.choice(['1', '1', '7'])}{sep}ddd{sep}ddd{sep}dddd", f"+44{sep}dd{sep}dddd{sep}dddd", f"+33{sep}d{sep}dd{sep}dd{sep}dd{sep}dd", "+49 (0)dd ddddd ddd", f"+{r.choice(['49', '43', '41', '39'])}{sep}ddd{sep}ddddddd", f"+34{sep}ddd{sep}ddd{sep}ddd", f"+86{sep}ddd{sep}dddd{sep}dddd", "+49 dd dddddddd", "+ddddddddddd",
             "(ddd) ddd-dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "1-ddd-ddd-dddd", "1.ddd.ddd.dddd", "ddd-dddd", "0dd/dddddddd", "0ddd/ddddddd", "0dd dddd dddd", "0dddd dddddd", "00dddddddddd", "00ddddddddddd", "001ddddddddddd", "00dd ddd ddddddd", "ddd ddd dddd"],
            [9, 8, 6, 6, 4, 4, 3, 3, 2, 9, 7, 4, 3, 3, 9, 6, 2, 6, 2, 4, 6, 5, 1, 2],
        )[0]
        out = self.filled(form)
        if r.random() < 0.15:
            out += r.choice([" ext. ", " ext ", " x", " extension "]) + self.digits(r.randint(2, 4))
        return out.translate({0x30 + i: 0xFF10 + i for i in range(10)}) if r.random() < 0.04 else out

    def identity_number(self) -> str:
        r = self.r
        form = r.choices(["ddd-dd-dddd", "ddd dd dddd", "AA-dddd-ddddd", "AA dddd ddddd", "AAddddddddd", "AdAddddddd", "A-ddddd-dd", "dddddd-ddddA", "AAddddddA", "ddddddddA"], [17, 14, 14, 12, 5, 14, 14, 14, 2, 2])[0]
        out = self.filled(form)
        return out.lower() if r.random() < 0.12 else out

    def place(self) -> str:
        return self.r.choice(["Old", "Mill", "Church", "Park", "Station", "King", "North", "Oak", "River", "Market"]) if self.r.random() < 0.25 else self.word().capitalize()

    def street_address(self) -> str:
        r = self.r
        n = f"{r.randint(1, 999)}" + (r.choice("abcd") if r.random() < 0.15 else "")
        kind = r.choices(["en", "de", "fr", "es", "zh"], [40, 16, 15, 15, 14])[0]
        if kind == "en":
            return f"{n} {r.choice(['N. ', 'S. ', 'E. ', 'W. ', 'N ']) if r.random() < 0.2 else ''}{' '.join(self.place() for _ in range(r.choice([1, 1, 2])))} {r.choice(_STREETS_EN).rstrip('.')}"
        if kind == "de":
            end = r.choice(_STREETS_DE)
            return r.choices([f"{self.place()}{end} {n}", f"{self.place()}er {end.capitalize()} {n}", f"{r.choice(['Alte', 'Neue', 'Kleine'])} {self.place()}{end} {n}"], [80, 12, 8])[0]
        of = r.choice(["", "de la ", "des ", "du ", "de ", "de l'"] if kind == "fr" else ["", "", "del ", "de la ", "de "])
        name = self.place() + (r.choice([" ", " ", "-"]) + self.place() if r.random() < 0.45 else "")
        if kind == "fr":
            return f"{n.rstrip('abcd')}{r.choice([',', ',', ' bis,', ' ter', ''])} {r.choice(_STREETS_FR)} {of}{name}"
        if kind == "es":
            return f"{r.choice(_STREETS_ES)} {of}{name}{r.choice(['', '', ','])} {n.rstrip('abcd')}"
        some = lambda a, b: "".join(r.choice(_PLACE_ZH) for _ in range(r.randint(a, b)))
        return f"{some(2, 2)}市{some(2, 2) + r.choice('区县') if r.random() < 0.8 else ''}{some(2, 3)}{r.choice(_STREETS_ZH)}{r.randint(1, 999)}号"

    def lookalike(self) -> str:
        """What is no mention: numbers of things, versions, hosts, handles, times, and names or street words alone."""
        r = self.r
        w = self.word()
        return r.choice([
            lambda: f"{r.choice(['Order', 'order', 'Ticket', 'Case', 'Bestellung', 'commande', 'pedido', '订单'])} {self.filled(r.choice(['dddd-dd-ddd', 'dddd-dddd', 'ddddd-ddd', 'dd-dddd-dd', 'dddddd', 'A-ddddd', 'AAA-dddd', 'dddddddd']))}",
            lambda: f"{r.choice(['ISBN ', 'ISBN-like code ', 'code ', 'EAN '])}{self.filled(r.choice(['ddd-d-ddd-d', '978-d-ddd-ddddd-d', 'ddddddddddddd', 'ddd-d-dddd-dddd-d']))}",
            lambda: f"{r.choice(['Case ', 'host ', 'ping ', 'from ', ''])}{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}{r.choice(['', ':8080', ':22', '/24'])}",
            lambda: f"{w}@{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 999)}", lambda: f"{w}@latest", lambda: f"Ping @{w}-oncall", lambda: f"@{w}", lambda: f"decorator @{w} hides it",
            lambda: f"{r.choice(['svc', 'git', 'root', w])}@{w}-{self.digits(2)}:{r.choice(['22', '/srv/' + w, '~/' + w])}", lambda: f"{w} at {w}", lambda: f"{w} at {self.word()}.", lambda: f"{w} dot {self.word()}",
            lambda: f"{r.choice(['v', 'version ', 'Version ', ''])}{r.randint(0, 30)}.{r.randint(0, 30)}.{r.randint(0, 999)}", lambda: f"{r.randint(1, 999)}.{self.digits(3)}.{self.digits(3)} requests", lambda: f"{r.randint(1, 999)},{self.digits(3)},{self.digits(3)}", lambda: f"{r.randint(1, 99)} {self.digits(3)} {self.digits(3)} rows",
            lambda: f"20{self.digits(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.20{self.digits(2)}", lambda: f"{r.randint(1, 12)}/{r.randint(1, 28)}/20{self.digits(2)} {r.randint(10, 23)}:{r.randint(10, 59)}", lambda: f"20{self.digits(2)}{self.digits(4)}T{self.digits(6)}Z", lambda: self.digits(r.choice([5, 6, 9, 10])),
            lambda: f"{self.digits(4)} ms", lambda: f"0x{r.getrandbits(32):08x}", lambda: f"{r.getrandbits(128):032x}", lambda: f"{r.getrandbits(32):08x}-{r.getrandbits(16):04x}-4{self.digits(3)}-{r.getrandbits(16):04x}-{r.getrandbits(48):012x}", lambda: f"{self.digits(4)}-{self.digits(4)}-{self.digits(4)}-{self.digits(4)}", lambda: f"${r.randint(1, 99)},{self.digits(3)}.{self.digits(2)}", lambda: f"{r.randint(1, 99)}.{self.digits(3)},{self.digits(2)} EUR",
            lambda: r.choice(_TITLES) + self.one_name("family"), lambda: self.one_name("given"), lambda: self.one_name("family"), lambda: f"{self.one_name('family')} {w}", lambda: f"the {self.one_name('family')} {r.choice(['team', 'index', 'method', 'report'])}", lambda: f"{self.one_name('given')} said", lambda: f"{self.place()} {self.place()}", lambda: f"the {self.place()} {r.choice(_STREETS_EN)}", lambda: f"{self.place()} {r.choice(_STREETS_EN)}", lambda: f"{self.place()} {r.choice(_STREETS_EN)} is {w}", lambda: f"{self.place()} {r.choice(_STREETS_EN)}, {self.place()}", lambda: f"{self.place()}{r.choice(_STREETS_DE)}", lambda: f"{r.choice(['rue', 'avenue', 'Calle', 'Plaza'])} {self.place()}",
            lambda: f"{w}.{self.word()}", lambda: f"{w}_{self.word()}.{r.choice(['py', 'md', 'txt', 'json'])}", lambda: f"{w}.{self.word()}.{self.word()}", lambda: f"{w}_{self.word().upper()}", lambda: f"{r.choice(['Part no. ', 'part ', 'No. ', 'serial ', 'SKU ', 'Teil ', 'ref. ', 'model '])}{self.filled(r.choice(['dd-dddd-ddd', 'dddd-ddd', 'dd-dddd', 'ddd-dd-ddd', 'ddddd-dd', 'A-dddd-dd', 'dd dddd ddd', 'ddd-dddddd']))}", lambda: f"{r.randint(2, 99)} {w}s", lambda: f"{r.randint(2, 99)} {self.place()} {w}",
            lambda: f"{self.place()} {self.digits(5)}", lambda: f"{self.digits(5)} {self.place()}", lambda: f"{self.place()}-{r.randint(1, 9)}", lambda: f"{w}-{self.digits(4)}", lambda: f"{w}_{w.upper()}={self.digits(4)}", lambda: f"Section {r.randint(1, 9)}.{r.randint(1, 9)}", lambda: f"{r.choice(_PLACE_ZH)}{r.choice(_PLACE_ZH)}{r.choice(['市', '路', '区'])}", lambda: f"第{r.randint(1, 99)}号",
        ])()

    def made(self, slot: str) -> tuple[str, str | None]:
        """The text of a slot and its type, None where it is no mention."""
        kinds = {"N": "person_name", "E": "email", "P": "phone", "I": "identity_number", "A": "street_address"}
        if slot in kinds:
            return getattr(self, kinds[slot])(), kinds[slot]
        plain = {"G": lambda: self.one_name("given"), "F": lambda: self.one_name("family"), "T": lambda: self.r.choice(["", *_TITLES]), "W": lambda: self.r.choice(_STARTS), "C": lambda: self.place(), "Z": lambda: self.digits(5), "X": self.lookalike}
        return (f"{self.one_name('given')} {self.one_name('family')}", "person_name") if slot == "GF" else (plain[slot](), None)


def labelled_lines(carriers: list[str], given: list[str], family: list[str], lines: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``lines`` rows (text, spans: (start, end, entity)). ``carriers``: lines of the corpus without mentions; none will do."""
    m = Maker(sorted(given), sorted(family), seed)
    r = m.r
    types = list(_LABELS)

    def carrier(most: int) -> str:
        words = re.findall(r"\S+\s*", r.choice(carriers)) if carriers else [m.word() + " " for _ in range(8)]
        at = r.randrange(max(1, len(words) - most + 1))
        return "".join(words[at : at + r.randint(1, most)])

    out = []
    for _ in range(lines):
        parts: list[tuple[str, str | None]] = []
        form = r.random()
        if form < 0.4:
            if r.random() < 0.5:
                parts.append((carrier(8).rstrip() + r.choice([" ", ". ", "。", "; ", " - "]), None))
            parts += [m.made(x[1:-1]) if re.fullmatch(r"\{[A-Z]{1,2}\}", x) else (x, None) for x in re.split(r"(\{[A-Z]{1,2}\})", r.choice(_SENTENCES)) if x]
            if r.random() < 0.5:
                parts.append((r.choice([" ", ". ", "。", "\n"]) + carrier(8), None))
        elif form < 0.6:
            kind = r.choice(types)
            parts += [(carrier(6).rstrip() + r.choice([" ", ". ", ", ", "。", " ("]) if r.random() < 0.6 else "", None), (r.choice(_LABELS[kind]), None), (getattr(m, kind)(), kind), (r.choice(_AFTER), None)]
            if r.random() < 0.5:
                parts.append((" " + carrier(6), None))
        elif form < 0.85:
            for _ in range(r.randint(1, 3)):
                kind = r.choice(types) if r.random() < 0.45 else None
                parts += [(carrier(7).rstrip() + " ", None), *([(r.choice(_TITLES), None)] if kind == "person_name" and r.random() < 0.25 else []), (getattr(m, kind)() if kind else m.lookalike(), kind), (r.choice([" ", ". ", ", ", " ", " | "]), None)]
        else:
            parts.append((carrier(30), None))
        text, spans = "", []
        for value, kind in parts:
            if kind:
                spans.append((len(text), len(text) + len(value), kind))
            text += value
        out.append((text, spans))
    return out
