"""Problem 3: personal information in free text, found by anchor expansion and replaced by typed placeholders.

An Aho-Corasick automaton finds all anchors in one pass: at-signs and their spellings, schemes, identifier and phone
cues, titles, street words, starts of digit groups, initials, signature dashes, given names and words that introduce a
person. From each anchor a deterministic local parser expands to the left and right and validates what it finds: the
parts of an address, the shape and check digits of an identity, account or card number, the national or international
form of a phone number, the style of a name. A number whose check digits do not hold counts only where a cue or a
contact line says what it is. Where findings overlap, the stronger type stands: email, identity number, phone,
address, name.

Given names are a short fixed list together with all names learned from the entities of kind person: the first
`GIVEN_LIMIT` of them are anchors of the automaton, the rest are looked up word by word, with the same findings.

Defined results: null and empty texts hold nothing and are kept; rows without an id have no findings; repeated rows give repeated findings unless the caller
drops them; an empty table gives an empty result; texts are read whole. Further columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.forms import _ODD, _TABLE

GIVEN_LIMIT = 2000
RUN = re.compile(r"[^\W_]+")
PLAIN = str.maketrans("áàâãéêèíïóôõúüçñëöä", "aaaaeeeiiooouucneoa")
TYPES = ("email", "id_number", "phone", "address", "name")

# Words that mark personal information, as lower-case text.
AT_SIGNS = ["@", "[at]", "(at)", "{at}", " arroba ", " at ", " klammeraffe "]
SCHEMES = ["mailto:", "tel:", "sip:", "whatsapp:"]
ID_CUES = (
    "social security|ssn|id number|id no|identity number|national insurance|passport|driving licence|driver's license|tax number|tax id|account number|card number|iban|"
    "identidad|documento|pasaporte|seguridad social|dni|nie|nif|número de cuenta|tarjeta|contribuinte|cpf|passaporte|cartão de cidadão|cartão|conta n|"
    "sécurité sociale|passeport|carte d'identité|avec le numéro|numéro de compte|carte n|steuernummer|steuer-id|ausweisnummer|personalausweis|reisepass|sozialversicherungsnummer|kontonummer|kartennummer|\"id\"|id:"
).split("|")
PHONE_CUES = (
    "call |text |phone|tel|mobile|cell|fax|ring |reach me|llama|llame|móvil|teléfono|appelez|téléphone|portable|ligue|telefone|telemóvel|celular|wählen|anrufen|rufen|handy|mobil|bitte| al | le | para | nach "
).split("|")
TITLES = "dr. dra. ms. mr. mrs. prof. sra. sr. herr frau monsieur madame mme senhor senhora señor señora mlle".split()
BEFORE_NAME = (
    "ask for|contact|speak to|speak with|talk to|talk with|according to|my name is|you can reach|opened by|cc:|\"name\":|regards,|pregunta por|pregunte por|hable con|contacta con|contacte a|me llamo|mi nombre es|según|escribir a|abierta por|"
    "demandez|contactez|parler à|parlez à|je m'appelle|selon|ouverte par|pergunte por|fale com|falar com|contate|chame|meu nome é|chamo-me|segundo|aberta por|fragen nach|fragen sie nach|sprechen mit|kontaktieren|ich heiße|mein name ist|laut"
).split("|")
NUMBER_IS_NO_PHONE = "run tanda rodada passage lauf version versión versão commit cambio stand alteração ticket aviso chamado meldung lote build".split()
GIVEN = (
    "daniel susan victoria gregory rebecca william robert margaret jennifer katherine patricia samuel oliver thomas elizabeth edward michael dolores nora peter john "
    "maría josé andrés tomás lucía guillermo mercedes rocío ramón inés pilar ignacio francisco "
    "élodie mathieu benoît hélène frédéric guillaume margaux solène thibault zoé friederike matthias jürgen günther wolfgang anneliese ute sebastian johannes katharina "
    "antônio fernanda beatriz rogério sebastião tânia luísa joão eduardo conceição "
    "james mary linda david barbara richard joseph sarah charles karen christopher nancy matthew anthony emma olivia sophia henry alice george "
    "carlos carmen juan ana luis elena javier isabel sergio raquel pierre claire jean camille antoine julien nathalie philippe "
    "hans klaus petra stefan monika thorsten sabine pedro miguel inês tiago rita paulo catarina bruno "
    "ahmed mohammed fatima omar aisha kwame ngozi chinedu yuki hiroshi wei mei priya raj arjun anjali olga ivan dmitri svetlana"
).split()
# Words that may follow a full stop, as after `plan B.`, or a name, and are no part of one.
AFTER_NAME = set(
    "at and for signed the by has was passport en y la el de después firmó unter und für hat zu et comme à a e com como pelo assinou avec voir fragen o os que after until should le les des du "
    "debe doit soll deve opción option".split()
)
# Street words of the five conventions of ADDRESS, in its order; those that end a German street's name stand apart.
STREETS = [
    "road rd street st avenue ave close lane ln court ct blvd boulevard drive dr way terrace place".split(),
    "c/ calle avda avenida plaza paseo ronda".split(),
    "rue avenue chemin allée boulevard impasse quai place".split(),
    "am |im |an der |auf dem ".split("|")[:-1],
    "rua av travessa avenida largo praça estrada".split(),
]
STREET_ENDS = "str. straße strasse weg gasse allee platz ring damm".split()

_CAP = r"(?:[A-ZÀ-ÞŒ](?:[^\W\d_]|['’\u0300-\u036f-])*(?!\w))"
_TOWN = rf"{_CAP}(?:[ -](?:(?:de|del|da|do|dos|das|du|la|le|am|sur|of) )?{_CAP})*"
ADDRESS = [
    re.compile(
        rf"(?:(?i:flat|unit|apt\.?|apartment) \w{{1,4}}, )?\b\d{{1,5}}[a-z]? (?:{_CAP} ){{1,3}}(?:Road|Rd\.?|Street|St\.?|Avenue|Ave\.?|Close|Lane|Ln\.?|Court|Ct\.?|Blvd\.?|Boulevard|Drive|Dr\.|Way|Terrace|Place)(?!\w)"
        rf"(?:, (?i:apt\.?|flat|unit) \w{{1,4}})?(?:, {_TOWN}(?: (?:\d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[A-Z\d]? ?\d[A-Z]{{2}})(?!\w))?)?"
    ),
    re.compile(rf"(?:C/|(?i:calle|avda\.?|avenida|plaza|paseo|ronda)) ?(?:(?:de|del|la|las|los|el) )*{_CAP}(?: {_CAP})*,? (?:nº ?|n\.º ?)?\d{{1,4}}(?!\d)(?:, \d{{1,2}}º ?[A-Z]?)?(?:, (?:\d{{5}} )?{_TOWN})?"),
    re.compile(rf"\b\d{{1,4}}(?: (?:bis|ter))?,? (?i:rue|avenue|chemin|allée|boulevard|impasse|quai|place) (?:(?:de|du|des|la|le|les) |de l['’]|l['’]|d['’])*{_CAP}(?: {_CAP})*(?:, (?:\d{{5}} )?{_TOWN})?"),
    re.compile(rf"\b(?:(?:Am|Im|An der|Auf dem) {_CAP}|[A-ZÄÖÜ][a-zäöüß-]+(?:str\.|straße|strasse|weg|gasse|allee|platz|ring|damm)) \d{{1,4}}[a-z]?(?!\w)(?:, (?:\d{{5}} )?{_TOWN})?"),
    re.compile(rf"(?i:rua|av\.|avenida|travessa|largo|praça|estrada) (?:(?:de|do|da|dos|das) )?{_CAP}(?: {_CAP})*, \d{{1,4}}(?!\d)(?:, (?i:apto\.?|andar) \w{{1,4}})?(?:, (?:\d{{4}}-\d{{3}} )?{_TOWN})?"),
]
_END = r"(?![\w-]|\.\d)"


def _luhn(d: str) -> bool:
    twice = [int(c) * 2 for c in d[-2::-2]]
    return (sum(int(c) for c in d[::-2]) + sum(t - 9 * (t > 9) for t in twice)) % 10 == 0


def _weighed(d: str, weights, mod: int = 11) -> int:
    return sum(int(c) * w for c, w in zip(d, weights)) % mod


def _cpf(d: str) -> bool:
    return len(set(d)) > 1 and _weighed(d + "0", range(10, 1, -1)) * 10 % 11 % 10 == int(d[9]) and _weighed(d, range(11, 1, -1)) * 10 % 11 % 10 == int(d[10])


def _iban(d: str) -> bool:
    return int("".join(str(int(c, 36)) for c in d[4:] + d[:4])) % 97 == 1


def _steuer_id(d: str) -> bool:
    p = 10
    for c in d[:10]:
        p = ((int(c) + p) % 10 or 10) * 2 % 11
    return d[0] != "0" and (11 - p) % 10 == int(d[10])


_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"
# Identity, account and card numbers by their public shapes, each with the test of its check digits or ranges (on letters and digits only).
IDS = [
    (re.compile(rf"(?:\d{{8}}|\d{{2}}\.\d{{3}}\.\d{{3}})-?[A-Z]{_END}"), lambda d: d[8] == _DNI[int(d[:8]) % 23]),
    (re.compile(rf"[XYZ]-?\d{{7}}-?[A-Z]{_END}"), lambda d: d[8] == _DNI[int(str("XYZ".index(d[0])) + d[1:8]) % 23]),
    (re.compile(rf"[12] ?\d{{2}} ?\d{{2}} ?\d{{2}} ?\d{{3}} ?\d{{3}} ?\d{{2}}{_END}"), lambda d: 97 - int(d[:13]) % 97 == int(d[13:])),
    (re.compile(rf"\d{{3}}\.\d{{3}}\.\d{{3}}-\d{{2}}{_END}"), _cpf),
    (re.compile(rf"\d{{2}} ?\d{{3}} ?\d{{3}} ?\d{{3}}{_END}"), _steuer_id),
    (re.compile(rf"(?!000|666)\d{{3}}([- ])(?!00)\d{{2}}\1(?!0000)\d{{4}}{_END}"), lambda d: True),
    (re.compile(rf"(?!BG|GB|NK|KN|TN|NT|ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d\d ?\d\d ?\d\d ?[A-D]{_END}"), lambda d: True),
    (re.compile(rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z\d]{{4}}){{3,7}}(?: ?[A-Z\d]{{1,3}})?{_END}"), _iban),
    (re.compile(rf"[3-6]\d{{3}}([ -]?)\d{{4}}\1\d{{4}}\1\d{{1,7}}{_END}|3[47]\d{{2}}([ -]?)\d{{6}}\2\d{{5}}{_END}"), _luhn),
    (re.compile(rf"\d{{8}} ?\d ?[A-Z]{{2}}\d{_END}|\d{{2}} ?\d{{6}} ?[A-Z] ?\d{{3}}{_END}|\d{{2}}/\d{{8}}/\d{{2}}{_END}|\d{{3}}/\d{{3}}/\d{{5}}{_END}"), lambda d: True),
]
LOOSE_ID = re.compile(r"(?:[A-Z]{1,3}-?)?\d(?:[ ./-]?[A-Z\d]+)+|[A-Z]{1,3} ?\d[\d ./-]{3,}[A-Z]?")
BEFORE_GROUP = "\n\t (;\"'<>,:/[{=\u00a0\u202f"
PHONE = re.compile(r"(?<![\w./#=@-])(?:\(?\+|\(\d{1,4}\) ?|00)?\(?\d[\d ().\-/   ]{5,22}\d(?![\w])")
EMAIL_RIGHT = re.compile(r"\s?((?:[a-z0-9-]+)(?:\s?(?:\.|\[dot\]|\(dot\)|\{dot\}|\sdot\s|\spunto\s|\spoint\s|\sponto\s|\spunkt\s)\s?[a-z0-9-]+)*\s?(?:\.|\[dot\]|\(dot\)|\{dot\}|\sdot\s|\spunto\s|\spoint\s|\sponto\s|\spunkt\s)\s?[a-z]{2,})", re.I)
EMAIL_LEFT = re.compile(r"([\w.+-]+)\s?$")
WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|['’\u0300-\u036f])*(?:-[^\W\d_](?:[^\W\d_]|['’\u0300-\u036f])*)*")
SIGNATURE = re.compile(r"-- ?\n+([^\n]{3,60})(?:\n|$)")
INITIAL_NAME = re.compile(r"((?:[A-ZÀ-Þ]\. ?){1,2}[A-ZÀ-Þ][a-zà-ÿ]{3,}(?:-[A-ZÀ-Þ][a-zà-ÿ]+)*|(?:[A-ZÀ-Þ]\. ?){1,2}[A-ZÀ-Þ]{4,}(?:-[A-ZÀ-Þ]+)*)(?!\w)")
_HONOURED = re.compile(r"\s?(?:(?:Dr|Dra|Ms|Mr|Mrs|Sr|Sra|M|Prof)\. |Herr |Frau |Monsieur |Madame |Mme )*")
_CAPITALS = re.compile(r"(?<![\w./#+-])[A-Z]{1,3}[ -]?$")
# Words of names of organisations, places and things.
NO_PERSON = set(
    "ltd inc llc gmbh corp company group bank services systems software labs team support university institute studio works house street road city "
    "equipo banco grupo universidad ciudad équipe banque groupe université ville gruppe stadt universität equipe universidade cidade".split()
)
INITIALS = "abcdefghijklmnopqrstuvwxyzáàâãéêèíóôõúüçñëöäÿøåæœ"
SURNAME_FIRST = re.compile(r"([A-ZÀ-Þ][^\W\d_]{3,}(?:-[A-ZÀ-Þ][^\W\d_]+)*), [A-ZÀ-Þ]\.(?! ?[A-ZÀ-Þ][^\W\d_]{3,})")
_LEFT_WORD = re.compile(rf"({WORD.pattern})$")
_CAP_WORDS = re.compile(r"[A-ZÀ-Þ][^\W\d_]+(?:['’-][^\W\d_]+)*(?: (?:(?:de|da|dos|von|van|del|la|al|el|bin) )?[A-ZÀ-Þ][^\W\d_]+(?:['’-][^\W\d_]+)*){1,2}")


def _phone_like(raw: str, cued: bool) -> bool:
    digits = re.sub(r"\D", "", raw)
    n = len(digits)
    if not 9 <= n <= 15 or re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", raw) or re.match(r"(?:19|20)\d\d-\d\d-\d\d", raw):
        return False
    if raw.count("(") != raw.count(")"):
        return False
    if "+" in raw or digits.startswith("00"):
        return True
    if re.match(r"\(0?\d{1,3}\)", raw):
        return True
    if re.fullmatch(r"[2-9]\d\d([-. ])\d{3}\1\d{4}", raw) or re.fullmatch(r"0\d{3,4} \d{6}", raw) or re.fullmatch(r"0\d(?:([ .])\d\d)(?:\1\d\d){3}", raw):
        return True
    if re.fullmatch(r"0\d{2,4} \d{3,6}[ -]\d{2,4}", raw) or re.fullmatch(r"0\d{2,4}/\d{5,8}", raw):
        return True
    if re.fullmatch(r"[26789]\d (?:\d{3} \d\d \d\d)", raw) or re.fullmatch(r"[679]\d\d(?: \d\d){3}", raw):
        return True
    return cued and (re.fullmatch(r"[2-9]\d{9}|[26789]\d{8}|[679]\d\d \d{3} \d{3}|0\d{9,10}", raw) is not None)


class Finder:
    """Anchors and parsers for one set of given names."""

    def __init__(self, given: list[str]) -> None:
        self.given = {g for g in [*GIVEN, *given]}
        self.given |= {g.translate(PLAIN) for g in self.given}
        # A given name counts only where it stands as a whole run of letters and digits, so a set finds the same as an automaton.
        first = {*GIVEN, *given[:GIVEN_LIMIT]}
        first |= {g.translate(PLAIN) for g in first}
        self.words = {g for g in self.given - first if RUN.fullmatch(g)}
        self.anchors = ahocorasick.Automaton()
        kinds: dict[str, list[str]] = {}
        streets = [(f"street{i}", words) for i, words in enumerate(STREETS)]
        groups = [c + d for c in BEFORE_GROUP for d in "0123456789+"] + ["(+", "(0"]
        shapes = [c + d for c in "abcdefghijklmnopqrstuvwxyz" for d in "0123456789"]
        initials = [c + x + "." for c in BEFORE_GROUP for x in INITIALS]
        more = (("scheme", SCHEMES), ("phone", PHONE_CUES), ("group", groups), ("shape", shapes), ("initial", initials), ("comma", [f", {x}." for x in INITIALS]), ("dashes", ["--"]))
        for kind, keys in (*more, ("at", AT_SIGNS), ("id", ID_CUES), ("title", TITLES), ("who", BEFORE_NAME), ("given", self.given - self.words), ("ends", STREET_ENDS), *streets):
            for k in keys:
                kinds.setdefault(k, []).append(kind)
        for k, v in kinds.items():
            self.anchors.add_word(k, (len(k), tuple(v)))
        self.anchors.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(begin, end, type) of the personal information in the text, in reading order, without overlap."""
        if not text:
            return []
        if _ODD.search(text):
            plain, at = [], []
            for i, ch in enumerate(text):
                to = _TABLE[ord(ch)]
                plain.append(to)
                at += [i] * len(to)
            return [(at[b], at[e - 1] + 1, t) for b, e, t in self._find("".join(plain))]
        return self._find(text)

    def _find(self, text: str) -> list[tuple[int, int, str]]:
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        hits: dict[str, list[tuple[int, int]]] = {}
        for end, (n, kinds) in self.anchors.iter("\n" + low):  # a text begins like a line
            for k in kinds:
                hits.setdefault(k, []).append((end - n, end))
        if self.words and (more := [m.span() for m in RUN.finditer(low) if m[0] in self.words]):
            hits["given"] = sorted(hits.get("given", []) + more, key=lambda h: (h[1], h[0]))
        found: list[tuple[int, int, str]] = []
        taken = bytearray(len(text))

        def take(b: int, e: int, kind: str) -> None:
            if b < e and not any(taken[b:e]):
                found.append((b, e, kind))
                taken[b:e] = b"\1" * (e - b)

        for b, e in hits.get("at", ()):
            left, right = EMAIL_LEFT.search(text, max(0, b - 80), b), EMAIL_RIGHT.match(text, e)
            spelled = low[b:e] == " at " or low[b:e] == " arroba "
            if left and right and (not spelled or re.search(r"\b(?:dot|punto|ponto|point|punkt)\b", right[0].lower()) or "[" in right[0]):
                take(left.start(1), right.end(1), "email")
        starts = sorted({self._number_start(text, e - 1) for _, e in hits.get("group", ())} | {self._number_start(text, e - 1) for _, e in hits.get("shape", ())})
        for start in starts:
            if start >= 0 and not taken[start] and not self._after(low, start, NUMBER_IS_NO_PHONE):
                for shape, holds in IDS:
                    if (m := shape.match(text, start)) and holds(re.sub(r"\W", "", m[0])):
                        take(m.start(), m.end(), "id_number")
                        break
        for b, e in hits.get("id", ()):
            if (b > 0 and low[b - 1].isalnum()) or (low[e - 1].isalpha() and low[e : e + 1].isalpha() and low[e] not in "ºª"):
                continue
            stop = re.search(r"[,;\n]|(?<=[^\W\d_])\. ", text[e : e + 70])
            area = text[e : e + (stop.start() if stop else 70)]
            if (m := LOOSE_ID.search(area)) and sum(c.isdigit() for c in m[0]) >= 5 and area[: m.start()].count(" ") <= 6:
                take(e + m.start(), e + m.end(), "id_number")
        cues, schemes = hits.get("phone", ()), {e for _, e in hits.get("scheme", ())}
        near = {e + k for _, e in cues for k in range(15)}  # places shortly behind a phone cue
        for at in sorted({e - 1 for _, e in hits.get("group", ())}):
            b = at - (at > 0 and text[at - 1] == "(")
            inner = b > 1 and text[b - 1] == " " and text[b - 2].isdigit()  # a further group of a number
            if taken[at] or inner or (b and text[b - 1] in ":=" and b not in schemes) or not (m := PHONE.match(text, b)):
                continue
            b, e = m.span()
            raw = text[b:e]
            while raw.count("(") > raw.count(")") and raw.startswith("("):
                b, raw = b + 1, raw[1:]
            while raw.count(")") > raw.count("("):
                e, raw = e - 1, raw[:-1]
            if self._after(low, b, NUMBER_IS_NO_PHONE):
                continue
            cued = b == 0 or b in schemes or b in near or low[max(0, b - 14) : b].rstrip(" ").endswith(("\n", ";", '"', "("))
            if _phone_like(raw.strip(), cued):
                take(b, e, "phone")
                if (n := re.compile(r"; ?").match(text, e)) and (i := LOOSE_ID.match(text, n.end())):  # a contact row: name; phone; number
                    take(i.start(), i.end(), "id_number")
        for i, parser in enumerate(ADDRESS):
            for b, e in sorted(self._streets(text, low, hits, i)):
                if not taken[b]:
                    for m in parser.finditer(text, max(0, b - 60), min(len(text), e + 160)):
                        if m.start() <= b < m.end():
                            take(m.start(), m.end(), "address")
        self._names(text, low, hits, take, taken)
        return sorted(found)

    @staticmethod
    def _number_start(text: str, at: int) -> int:
        """Where the number begins whose first digit is at `at`: up to three capitals before it belong to it; -1 inside a word, path or number."""
        if m := _CAPITALS.search(text, max(0, at - 5), at):
            return m.start()
        return -1 if at < 0 or (at and (text[at - 1].isalnum() or text[at - 1] in "_./#+-")) or not text[at].isdigit() else at

    @staticmethod
    def _streets(text: str, low: str, hits: dict, i: int) -> set[tuple[int, int]]:
        """The street words of convention i that stand in the text as words, or end one for German names."""
        found = set()
        for b, e in hits.get(f"street{i}", ()):
            bounded = (b == 0 or not low[b - 1].isalnum()) and (e == len(low) or not low[e].isalnum() or low[e - 1] in " /")
            if bounded and (i != 3 or text[b].isupper()):
                found.add((b, e))
        if i == 3:
            found |= {(b, e) for b, e in hits.get("ends", ()) if b > 0 and low[b - 1].isalpha() and (e == len(low) or not low[e].isalnum())}
        return found

    @staticmethod
    def _after(low: str, b: int, words: list[str]) -> bool:
        before = low[max(0, b - 16) : b].rstrip(" #").rsplit(" ", 1)[-1].rsplit("\n", 1)[-1]
        return before in words

    def _names(self, text: str, low: str, hits: dict, take, taken: bytearray) -> None:
        for b, e in hits.get("given", ()):
            if (b > 0 and (low[b - 1].isalnum() or low[b - 1] in "-_./@+'" or unicodedata.combining(low[b - 1]))) or (e < len(low) and (low[e].isalnum() or low[e] in "_@/")) or taken[b]:
                continue
            take(*self._around(text, low, b, e), "name")
        for b, e in hits.get("title", ()):
            if (b and low[b - 1].isalnum()) or text[b].islower():
                continue
            at = e
            while m := re.match(r" ?(?:Dr\.|Dra\.|Prof\.)", text[at:]):
                at += m.end()
            if (m := re.compile(rf" ((?:[A-ZÀ-Þ]\. ?)*{WORD.pattern})").match(text, at)) and m[1][0].isupper() and m[1].lower() not in AFTER_NAME and len(m[1]) > 2:
                take(m.start(1), m.end(1), "name")
        for _, e in hits.get("initial", ()):
            b = e - 2
            if not taken[b] and (m := INITIAL_NAME.match(text, b)) and not self._sentence_end(m[1]):
                take(m.start(1), m.end(1), "name")
        for b, e in hits.get("comma", ()):
            if (w := _LEFT_WORD.search(text, max(0, b - 40), b)) and (m := SURNAME_FIRST.match(text, w.start())) and m.end() == e and w[1].lower() not in AFTER_NAME:
                take(m.start(), e - 1, "name")
        for b, e in hits.get("who", ()):
            if b > 0 and low[b - 1].isalnum():
                continue
            self._after_cue(text, low, e, take, taken)
        for b, _ in hits.get("dashes", ()):
            if (b <= 0 or text[b - 1].isspace() or text[b - 1] == "/") and (m := SIGNATURE.match(text, max(0, b))):
                name = re.sub(r"^(?:(?:Dr|Dra|Ms|Mr|Mrs|Sr|Sra|M|Prof)\.|Herr|Frau|Monsieur|Madame|Mme)(?: (?:Dr|Prof)\.)? ", "", m[1].strip())
                b = m.start(1) + m[1].index(name)
                if re.fullmatch(r"[^\d@<>{}]+", name) and 1 <= len(name.split()) <= 4:
                    take(b, b + len(name), "name")

    @staticmethod
    def _sentence_end(name: str) -> bool:
        """An initial that ends a sentence, as in `plan B. The`: a word follows that begins sentences."""
        return name.split(".")[-1].strip().lower() in AFTER_NAME

    def _around(self, text: str, low: str, b: int, e: int) -> tuple[int, int]:
        """The whole name around a given name."""
        given = text[b:e]
        at = e
        if text.startswith("-", e) and (m := WORD.match(text, e + 1)):  # a double given name
            at = m.end()
        if (m := re.compile(r" ((?:[A-Za-zÀ-Þ]\. ?){1,2})").match(text, at)) and (n := WORD.match(text, m.end() if text[m.end() - 1] == " " else m.end() + (text[m.end() : m.end() + 1] == " "))) and n[0].lower() not in AFTER_NAME and n[0][0].isupper() == given[0].isupper():
            return b, n.end()
        if (m := re.compile(" ").match(text, at)) and (n := WORD.match(text, m.end())):
            word = n[0]
            fits = word.lower() not in AFTER_NAME and len(word) > 3
            if given.islower():
                fits = fits and word.islower()
            elif given.isupper() and len(given) > 1:
                fits = fits and word[0].isupper()
            else:
                fits = fits and word[0].isupper()
            if fits:
                return b, n.end()
        if (m := re.compile(rf"({WORD.pattern}), ?$").search(text, max(0, b - 40), b)) and len(m[1]) > 3 and m[1].lower() not in AFTER_NAME and (m[1][0].isupper() or given.islower()):
            tail = re.compile(r" [A-ZÀ-Þ]\.(?=\W)").match(text, e)
            return m.start(1), (tail.end() - 1 if tail else e)
        return b, at

    def _after_cue(self, text: str, low: str, e: int, take, taken: bytearray) -> None:
        m = _HONOURED.match(text, e)
        at = m.end() if m else e
        if (n := re.compile(rf"(?:[A-ZÀ-Þ]\. ?)+{WORD.pattern}").match(text, at)) or (n := _CAP_WORDS.match(text, at)):
            words = re.split(r"[ .]+", n[0])
            if not taken[n.start()] and not any(w.lower() in AFTER_NAME for w in words) and not any(w.lower() in NO_PERSON for w in words) and not re.match(r"[ -]?v?\d|[/_@]", text[n.end() : n.end() + 3]):
                take(n.start(), n.end(), "name")


def key_of(piece: str) -> str:
    """The piece in lower case with its letters and digits only."""
    return "".join(c for c in piece.lower() if c.isalnum())


def learn_given(entities: DataFrame, name: str, kind: str, least: int = 2, limit: int | None = None) -> list[str]:
    """Given names: first words of two-word person names that stand before several different surnames, those of most surnames first."""
    people = entities.where(F.lower(kind).rlike("^(person|people)")).where(F.col(name).rlike(r"^\p{Lu}\p{L}{2,} \p{Lu}\p{L}{3,}$"))
    words = people.select(F.lower(F.split(name, " ")[0]).alias("given"), F.lower(F.split(name, " ")[1]).alias("surname"))
    many = words.groupBy("given").agg(F.approx_count_distinct("surname").alias("n")).where(F.col("n") >= least)
    ranked = many.orderBy(F.desc("n"), "given")
    return [r.given for r in (ranked if limit is None else ranked.limit(limit)).collect()]


def _scan(finder):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: Finder = finder()
        for b in batches:
            rows = []
            for tab, rec, text in zip(b["tab"], b["rec_id"], b["text"]):
                for begin, end, kind in known.find(text):
                    if key := key_of(text[begin:end]):
                        rows.append((tab, rec, kind, key, begin, end))
            yield pd.DataFrame(rows, columns=["tab", "rec_id", "pii_type", "val_key", "from_char", "to_char"])

    return run


_FINDERS: dict[tuple, Finder] = {}


def _finder(given: tuple[str, ...]):
    """A maker of the finder, built once per worker process."""

    def make() -> Finder:
        if given not in _FINDERS:
            _FINDERS[given] = Finder(list(given))
        return _FINDERS[given]

    return make


def findings(texts: DataFrame, given: list[str]) -> DataFrame:
    """Rows (tab, rec_id, pii_type, val_key, from_char, to_char) for a table (tab, rec_id, text)."""
    rows = texts.where(F.col("text").isNotNull() & F.col("rec_id").isNotNull()).select("tab", "rec_id", "text")
    return rows.mapInPandas(_scan(_finder(tuple(given))), "tab string, rec_id long, pii_type string, val_key string, from_char int, to_char int")


def redact(texts: DataFrame, given: list[str], text: str = "text", out: str = "redacted") -> DataFrame:
    """texts with `out`: the text with every finding replaced by `[EMAIL]`, `[PHONE]`, ... and the rest as it was."""
    make = _finder(tuple(given))

    def replace(column: pd.Series) -> pd.Series:
        known, done = make(), []
        for t in column:
            parts, at = [], 0
            for b, e, kind in known.find(t) if t else ():
                parts += [t[at:b], f"[{kind.upper()}]"]
                at = e
            done.append(t if t is None else "".join(parts) + t[at:])
        return pd.Series(done, dtype=object)

    return texts.withColumn(out, F.pandas_udf(replace, "string")(text))
