"""Personal information in free text: found, and replaced by a placeholder of its kind.

Candidate spans come from generous patterns. Labelers vote on each one: the exact shapes, number plans, label words of
everyday language near by, a gazetteer of names, a letter model trained on it, and how a word is written elsewhere in
the documents. A labeler may abstain, which says nothing. None is trusted as such: expectation-maximisation over the
vote patterns of all candidates of all documents estimates how often each one is right, without any labels; that gives
every pattern a probability. A classifier of spans is then trained on those (logistic regression over the votes and
the form of the span and its surroundings, no words), and decides. It learns every pattern a second time with the
context blanked, so that a value whose form is plain enough is found in a sentence of any kind. Of decided spans that
overlap the likelier is kept.

What reaches the driver is bounded by parameters, whatever the documents: counts of vote patterns, of letter trigrams,
and how often words are written small and with a capital in WORD_SLOTS hashed slots. All documents count in each of
them, and all candidates in the training. Texts are processed whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevec.functions import text as T
from lodevec.session import BROADCAST_LIMIT, written

KINDS = ("email", "phone", "ident", "address", "name")
#: Buckets of features, and slots that words are hashed to; a slot is two bytes.
BUCKETS, WORD_SLOTS = 1 << 16, 1 << 20
PLACEHOLDER = "[{}]"

_B = r"[  ]"  # a blank inside a value
_AT = rf"(?:@|{_B}?[\[(\{{](?:at|AT|At)[\])\}}]{_B}?)"
_SPELT = rf"(?:{_B}?[\[(\{{](?:dot|DOT|Dot)[\])\}}]{_B}?|{_B}(?:dot|DOT){_B})"
_DOT = rf"(?:\.|{_SPELT})"
_LOCAL, _LABEL = r"[A-Za-z0-9](?:[\w.+%-]*[A-Za-z0-9_])?", r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_CAP = r"\p{Lu}(?:[\p{L}\p{M}]|['’](?=\p{L}))*"
_PART = rf"{_CAP}(?:-{_CAP})*"
_PARTICLE = r"(?:v[aáàâä]n|v[oóòôö]n|d[eéèêë]l?|d[aáàâä]|d[uúùûü]|d[oóòôö]s|l[aáàâä]|t[eéèêë][nr])"
_TOWN = rf"{_CAP}(?:[- ]{_CAP})?"
_TYPE = r"(?i:street|road|avenue|lane|court|terrace|drive|place|square|close|way|boulevard|ln|rd|ave|st|blvd|dr)\b\.?"
_NUM = r"\d{1,5}(?:[a-zA-Z]\b)?"
_SEP = r"(?:,\s?|\s)"

CANDIDATES = {
    "email": [
        rf"(?<![\w.+%@-]){_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})+",
        rf"(?<![\w.+%@-]){_LOCAL}{_B}(?:at|AT){_B}{_LABEL}(?:{_SPELT}{_LABEL})+",
    ],
    "phone": [r"(?<![\w.+])(?:\+|\(|\d)(?:[\d()]|[  .\-/](?=[\d(])){5,20}\d(?![\w])"],
    "ident": [
        r"(?<![\w-])[A-Z]{1,3}[ -]?(?:\d[ -]?){5,9}[A-Z]?(?![\w-])",
        r"(?<![\w-])[A-Z]{1,2}\d{2}[ -]?[A-Z]\d{4,6}(?![\w-])",
        r"(?<![\w.+(-])\d{2,4}[ -]\d{2,4}[ -]\d{2,5}(?:[ -]\d{2,4})?(?![\w-])",
        r"(?<![\w-])\d{8,12}(?![\w-])",
        r"(?<![\w-])(?:[XYZ]-?\d{7}|\d{8})-?[A-Z](?![\w-])",
        r"(?<![\w.+(-])(?:[12] \d\d \d\d \d\d \d{3} \d{3}(?: \d\d)?|\d\d \d{3} \d{3} \d{3})(?![\w-])",
    ],
    "address": [
        rf"(?<![\w.-]){_NUM}{_B}(?:{_CAP}{_B}){{1,3}}{_TYPE}(?:,{_B}(?i:flat|apt|apartment|unit|suite)\.?{_B}\w{{1,5}})?(?:,?\s{{1,2}}{_TOWN}(?:,?{_B}\d{{4,5}}\b)?)?",
        rf"(?<![\w-])(?:\p{{Lu}}[\p{{L}}]*(?i:straße|strasse|str\.|stra\p{{L}}+|weg|gasse|platz|allee)|(?:Am|Im|An der|Auf der|Zum){_B}{_CAP}){_B}\d{{1,4}}{_B}?[a-z]?(?:,\s{{1,2}}\d{{4,5}}{_B}{_TOWN})?",
        rf"(?<![\w.-])\d{{1,4}}(?:{_B}(?:bis|ter|quater))?,?{_B}(?i:rue|avenue|boulevard|place|chemin|quai|impasse){_B}(?:(?:de|du|des|de la){_B}|d['’])?{_CAP}(?:,\s{{1,2}}\d{{4,5}}{_B}{_TOWN})?",
        rf"(?<![\w-])(?:(?i:calle|avenida|plaza|paseo)){_B}(?:(?:de|del|de la){_B})?{_CAP},{_B}\d{{1,4}}(?:,{_B}\d{{1,2}}\.?[ºªo°]?{_B}?\p{{Lu}}?)?(?:,\s{{1,2}}\d{{4,5}}{_B}{_TOWN})?",
        rf"(?:(?i:flat|apt|apartment|unit|suite)\.?{_B}\w{{1,5}},{_B})(?<![\w.-]){_NUM}{_B}(?:{_CAP}{_B}){{1,3}}{_TYPE}(?:,{_B}(?i:flat|apt|apartment|unit|suite)\.?{_B}\w{{1,5}})?(?:,?\s{{1,2}}{_TOWN}(?:,?{_B}\d{{4,5}}\b)?)?",
    ],
}

_S = r"[-. \xa0]"  # a separator inside a number
#: Function words, titles and words of addresses in four languages; no part of a name.
_TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "professor", "sir", "herr", "frau", "mme", "mlle", "monsieur", "madame", "señor", "señora", "sr", "sra", "don", "doña"}
_FUNCTION = {
    *"the a an this that these those it its he she they we you our your my his her their no not if when while after before during each every "
    "all some any most few both with without within from for to into in on at by of off as and or but nor so yet because since until than then "
    "there here who whom whose which what why how does do did is are was were be been has have had will would can could may might must should "
    "shall let us me him them i nobody somebody everybody anybody someone everyone anyone please dear hello hi thanks thank regards".split(),
    *"der die das den dem des ein eine einer eines einem einen wir ihr sie ich er es du für ohne mit nach bei von zu zum zur am im ist sind war "
    "keine keinen kein jede jeder jedes jeden alle welche welcher welches auf aus über unter und oder aber nicht wenn als wie wo wer was".split(),
    *"le la les l un une des du de au aux et ou où nous vous il elle ils elles on je tu ce cet cette ces après avant pour sans avec chez dans sur "
    "qui que quel quelle est sont près chaque aucun aucune tous toutes".split(),
    *"mount mt lake saint port fort cape river isle castle street road avenue lane court terrace square boulevard calle avenida plaza paseo".split(),
    *"el los las lo una unos unas y o u e nosotros según para por con desde en del al que es son su sus se qué cada todo todos toda todas ningún ninguna".split(),
}
#: What is named after persons or carries two capitals: places before the name, other nouns behind it.
_THING_BEFORE = regex.compile(r"(?:^|\W)(?:the|mount|mt\.?|lake|saint|st\.?|port|fort|cape|river|isle|castle|university of|der|die|das|dem|den|des|le|la|les|el|los|las|mont|lac|monte|lago|río)\W$", regex.I)
_THING_AFTER = regex.compile(
    r"(?:['’]s)?[- \xa0](?:transform|bound|theorem|lemma|conjecture|inequality|equation|index|algorithm|method|test|law|effect|distance|metric|model|number|constant|process|filter|kernel|space|"
    r"group|field|prize|award|medal|cup|street|road|avenue|lane|court|terrace|drive|bridge|square|park|airport|station|university|college|school|institute|library|museum|hospital|foundation|"
    r"society|company|inc|ltd|gmbh|castle|church|river|lake|bay|island|valley|disease|syndrome|ave|rd|ln)\b", regex.I)  # fmt: skip
#: Label words of everyday language; the nearest one before a value says what it is.
_CUES = {
    "phone": r"(?:tele)?phones?|phoned?|tel|mobiles?|cell(?:phone)?|landline|fax|call(?:ed|ing|s)?|ring|rang|dial(?:led)?|sms|whatsapp|hotline|voicemail|reach(?:ed|able)?|texted|"
             r"telefon\w*|handy(?:nummer)?|mobil\w*|rufnummer|ruf\w*|anruf\w*|erreich\w*|durchwahl|t[ée]l[ée]phon\w*|t[ée]l|portable|appel\w*|joindre|joignable|tel[ée]fono|m[óo]vil|celular|ll[aá]m\w*|marc(?:ar|a|ando)",
    "ident": r"ssn|itin|tin|social security|national insurance|ni (?:number|no)|nino|tax(?:payer)?(?:'s)?|passports?|driv(?:er'?s?|ing) licen[cs]e|licen[cs]e|identity|id(?: card| number| no)|identification|"
             r"ausweis\w*|personalausweis\w*|reisepass\w*|passnummer|steuer\w*|sozialversicherung\w*|f[üu]hrerschein\w*|passeport|identit[ée]|permis|s[ée]curit[ée] sociale|fiscale?|"
             r"pasaporte|dni|nie|nif|documento|identidad|seguridad social|licencia|c[ée]dula",
    "address": r"address|addr|lives?|living|lived|resid\w+|home|house|deliver\w*|ship(?:ped)?|parcel|mail(?:ed)? to|moved|visit\w*|anschrift|adresse\w*|wohn\w*|zuhause|habit\w*|demeure|domicil\w+|vive[ns]?|direcci[óo]n|reside[n]?",
    "email": r"e-?mails?|mail(?:to)?|contact|write|wrote|reply|address|inbox|cc|correo|[ée]crire|courriel|schreib\w*|adresse|escrib\w*|contacto",
    "other": r"orders?|invoices?|tickets?|cases?|issue|bug|parts?|items?|articles?|sku|serial|models?|batch|lots?|rows?|lines?|columns?|pages?|chapters?|sections?|figures?|tables?|versions?|builds?|releases?|"
             r"commits?|revisions?|runs?|jobs?|tasks?|seeds?|steps?|epochs?|iter(?:ation)?s?|checksums?|hash|ports?|ip|windows?|ranges?|isbn|issn|doi|tracking|flight|dates?|time|size|score|"
             r"bestell\w*|rechnung\w*|auftrag\w*|teile?(?:nummer)?|zeilen?|seiten?|lauf|fenster|commande|facture|lignes?|pi[èe]ce|fen[êe]tre|pedido|factura|l[íi]nea|filas?|p[áa]gina|pieza|ventana",
}
_NAME_CUES = r"mr|mrs|ms|miss|dr|prof|professor|sir|herr|frau|mme|mlle|monsieur|madame|señora?|sra?|don|doña|contact|contacto|kontakt|author|auteur|autor|editor|written|signed|sincerely|regards|name|named|called|nom|nombre|from|by|cc|attn|user|customer|patient|employee|ask for|met|thanks to"
_CUE = regex.compile(r"(?<![\p{L}\p{M}])(?:" + "|".join(f"(?P<{k}>{v})" for k, v in _CUES.items()) + r")(?![\p{L}\p{M}])", regex.I)
_NAME_CUE = regex.compile(rf"(?<![\p{{L}}\p{{M}}])(?:{_NAME_CUES})(?![\p{{L}}\p{{M}}])[^\p{{L}}\p{{M}}\d]{{0,5}}$", regex.I)
_BREAK = regex.compile(r"(?:(?<=\p{L}{4})\.|[!?;])\s|[\r\n]")
_UNIT = regex.compile(r"^\s?(?:ms|s|sec|mb|gb|kb|%|percent|rows?|boxes|pieces|items?|lines?|times|years?|days?|hits)\b", regex.I)
_EXTENSION = regex.compile(r"^\W{0,3}(?:ext|extension|x\d)", regex.I)
#: Country codes a number may start with after its plus sign or 00: of one digit, and first digits of the others.
_COUNTRY = regex.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689]\d|3[578]\d|42\d|5[09]\d|6[7-9]\d|8[05789]\d|9[679]\d")
_SHAPE = {
    "email": r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+",
    "phone": rf"(?:\+\d{{10,14}}|(?:\+|00)\d{{1,3}}{_B}(?:\(\d{{2,4}}\){_B})?\d{{2,6}}(?:{_S}\d{{2,6}}){{0,4}}|\(\d{{3}}\){_B}?\d{{3}}{_S}\d{{4}}|\d{{3}}({_S})\d{{3}}\1\d{{4}}|0\d{{3,4}}{_B}\d{{3}}{_B}\d{{3,4}}|0\d({_S})\d\d(?:\2\d\d){{3}}|0\d{{10}})",
    "ident": r"(?:\d{3}([ -])\d{2}\1\d{4}|\d\d-\d{3}-\d{3}-\d\d|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[A-Z]{2}\d{7}|[A-Z]{2}\d{2}-[A-Z]\d{5}|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|[12] \d\d \d\d \d\d \d{3} \d{3}(?: \d\d)?|\d\d \d{3} \d{3} \d{3})",
    "address": r"(?s:.*\b\d{4,5}\b.*|(?i:flat|apt)\b.*|\d+ \p{Lu}.*,.*)",
}
_MAYBE = {"phone": r"\(?0\d{2,5}\)?[ /-]?\d{3,}[\d -]*|\d{3}[ -]\d{3}[ -]\d{3}|[2-9]\d{9}", "ident": r"[A-Z]\d{6,8}|[A-Z]{2,3}\d{5,6}|\d{9,11}"}
_HOUSE = re.compile(r"\d[a-zA-Z]?[ \xa0][^\W\d_a-z]")
#: Cheap patterns that a text must hold for one of the others to be tried.
_GATES = {("address", 0): _HOUSE, ("address", 4): _HOUSE, ("ident", 4): re.compile(r"\d{7}-?[A-Z]"), ("ident", 5): re.compile(r"\d \d\d[ \d]")}
_CODE, _AREA = regex.compile(r"(?:\+|00)(\d+)"), regex.compile(r"\(?([2-9]\d\d)\)?\D{1,2}([2-9]\d\d)\D\d{4}$")
_MAIL_NEXT = regex.compile(r"\W{0,3}\S+@")
_DATE = regex.compile(r"(?:19|20)\d\d[-./]?(?:0\d|1[0-2])[-./]?(?:[0-2]\d|3[01])(?:\D.*)?")
_IP, _DECIMAL = regex.compile(r"\d{1,3}(?:\.\d{1,3}){3}"), regex.compile(r"\d+\.\d+")
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_START = regex.compile(r"(?:^|[.!?:\r\n])[^\p{L}\p{M}\d]*$")
_CAPITAL = regex.compile(rf"(?<![\p{{L}}\p{{M}}\d'’.-])(?:(?:\p{{Lu}}\.)+(?!\p{{L}})|{_PART})")
_GAP = regex.compile(rf"{_B}(?:(?P<particle>{_PARTICLE}){_B})*")
_COMMA, _LEAD = regex.compile(rf",{_B}"), regex.compile(rf"(?<![\p{{L}}\p{{M}}])v[aáàâäoóòôö]n{_B}(?:d[eé][rn]?{_B})?$")
#: What a text must hold, in lower case, for a pattern to be tried: any of these.
_UNITS = ("flat", "apt", "apartment", "unit", "suite")
_NEEDS = {
    ("email", 0): ("@", "[at]", "(at)", "{at}"), ("email", 1): (" dot ", " dot ", "[dot]", "(dot)", "{dot}"),
    ("address", 0): ("street", "road", "avenue", "lane", "court", "terrace", "drive", "place", "square", "close", "way", "boulevard", " ln", " rd", " ave", " st", " blvd", " dr"),
    ("address", 1): ("stra", "str.", "weg", "gasse", "platz", "allee", "Am ", "Im ", "An der ", "Auf der ", "Zum "),
    ("address", 2): ("rue", "avenue", "boulevard", "place", "chemin", "quai", "impasse"), ("address", 3): ("calle", "avenida", "plaza", "paseo"), ("address", 4): _UNITS,
}
_COMPILED: dict[str, dict] = {}


def _patterns(kind: str) -> dict:
    if not _COMPILED:
        for k in KINDS:
            _COMPILED[k] = {"find": [regex.compile(p) for p in CANDIDATES.get(k, ())], "shape": regex.compile(_SHAPE.get(k, "")), "maybe": regex.compile(_MAYBE.get(k, "(?!)"))}
    return _COMPILED[kind]


def plain(s: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))


def slots(word: str) -> tuple[int, int]:
    """The two slots of a word; the smaller count of both is its own unless it meets others in both."""
    return zlib.crc32(word.encode()) % WORD_SLOTS, zlib.crc32(word.encode() + b"#") % WORD_SLOTS


class Gazetteer:
    """Known names, a letter model of them (trigram log-odds against ordinary words), and how often words are written
    small and with a capital in the documents, by hashed slot, as 4 * log2(1 + n)."""

    def __init__(self, names: list[str], grams: dict[str, int], small: np.ndarray | None = None, capital: np.ndarray | None = None) -> None:
        self.names = {plain(p) for n in names for p in regex.split(r"[-\s'’]", n) if len(p) > 2}
        yes = Counter(g for p in self.names for g in self._grams(p))
        ty, tn = sum(yes.values()) + 1, sum(grams.values()) + 1
        self.odds = {g: math.log((yes[g] + 0.3) / ty) - math.log((grams.get(g, 0) + 0.3) / tn) for g in yes.keys() | grams.keys()}
        none = np.zeros(WORD_SLOTS, "u1")
        self.small, self.capital = none if small is None else small, none if capital is None else capital
        self.known: dict[str, tuple[bool, float, int]] = {}

    @staticmethod
    def _grams(p: str) -> list[str]:
        return [f"^{p}$"[i : i + 3] for i in range(len(p))]

    def word(self, w: str) -> tuple[bool, float, int]:
        """(is it a known name, mean log-odds of its letters, -1 where it is often written small)."""
        if (got := self.known.get(w)) is None:
            p, low = plain(w), w.lower()
            at = list(slots(low))
            small, capital = int(self.small[at].min()), int(self.capital[at].min())
            often = small >= 6 and small > capital - 7
            g = self._grams(p)
            got = p in self.names, sum(self.odds.get(x, 0.0) for x in g) / max(1, len(g)), -1 if often else 0
            if len(self.known) < 100_000:
                self.known[w] = got
        return got


@dataclass
class Span:
    start: int
    end: int
    kind: str
    value: str
    votes: tuple[int, ...]
    form: str


#: Labelers of values and of names: 1 says yes, -1 no, 0 nothing. The last CONTEXT ones look at what stands around.
LABELERS = {"value": ("shape", "plan", "cue", "after", "glued"), "name": ("known", "all known", "letters", "written", "thing", "longer", "cue")}
CONTEXT = {"value": 3, "name": 1}


def _cue(before: str) -> str | None:
    """The kind that the nearest label word before says, in the same sentence and with no other number between."""
    cut = 0
    for m in _BREAK.finditer(before):
        cut = m.end()
    got, at = None, 0
    for m in _CUE.finditer(before, cut):
        got, at = m.lastgroup, m.end()
    return None if got and any(c.isdigit() for c in before[at:]) else got


def _value_votes(kind: str, value: str, text: str, start: int, end: int) -> tuple[int, ...]:
    p, digits = _patterns(kind), sum(c.isdigit() for c in value)
    shape = 1 if p["shape"].fullmatch(value) else 0 if p["maybe"].fullmatch(value) or kind in ("email", "address") else -1
    cue, after = _cue(text[max(0, start - 70) : start]), text[end : end + 20]
    plan = 0
    if kind == "phone":
        code = _CODE.match(value)
        lead = _AREA.match(value)
        plan = 1 if code and _COUNTRY.match(code[1]) or lead else 0
        if not 9 <= digits <= 15 or value.count("(") != value.count(")") or _IP.fullmatch(value) or _DECIMAL.fullmatch(value) or _DATE.fullmatch(value):
            plan = -1
    elif kind == "ident":
        plan = -1 if not 7 <= digits <= 15 or _DATE.fullmatch(value) or _patterns("phone")["shape"].fullmatch(value) and shape < 1 else 0
    elif kind == "email":
        plan = -1 if value.lower().endswith((".py", ".txt", ".csv", ".png", ".jpg")) or not value[-1].isalpha() else 1
    elif kind == "address":
        plan = 1 if digits >= 5 else 0
    if kind in ("phone", "ident"):
        said = 1 if cue == kind else -1 if cue in ("other", "phone", "ident") else 0
        behind = -1 if _UNIT.match(after) else 1 if kind == "phone" and _EXTENSION.match(after) else 0
        glued = -1 if cue is None and start and text[start - 1] in "=#_/\\" else 0
    else:
        said, behind, glued = 1 if cue == kind else 0, 0, 0
    return shape, plan, said, behind, glued


def _side(text: str, at: int) -> str:
    c = text[at] if 0 <= at < len(text) else "\n"
    return "n" if c in "\r\n" else "b" if c.isspace() else "w" if c.isalnum() else "q" if c in "\"'<>()[]{}" else c if c in ".,;:=/-" else "o"


def _values(text: str, kind: str, low: str) -> Iterator[Span]:
    seen = set()
    for n, find in enumerate(_patterns(kind)["find"]):
        gate = _GATES.get((kind, n))
        if gate and not gate.search(text):
            continue
        need = _NEEDS.get((kind, n))
        if need:
            for x in need:
                if x in low or x[0].isupper() and x in text:
                    break
            else:
                continue
        for m in find.finditer(text):
            s, e = m.span()
            value = m[0]
            if (s, e) in seen or kind == "address" and e < len(text) and value[-1] == " ":
                continue
            seen.add((s, e))
            form = f"{n}{'a' if value[0].isalpha() else value[0] if value[0] in '+(' else '0'}{min(sum(c.isdigit() for c in value), 15)}|{_side(text, s - 1)}|{_side(text, e)}"
            yield Span(s, e, kind, value, _value_votes(kind, value, text, s, e), form)


def _names(text: str, g: Gazetteer) -> Iterator[Span]:
    """Pairs and triples of capitalised words and initials that could be a name. A word that is often written small,
    or an unknown one that starts a sentence, can only be a first one with a single word behind it."""
    tokens = []  # (start, end, sort): i an initial, n could be a name, o ordinary, x no part of a name
    for m in _CAPITAL.finditer(text):
        w = m[0]
        low = w.lower()
        if w[-1] == ".":
            sort = "i"
        elif len(w) < 2 or low in _FUNCTION or low in _TITLES:
            sort = "x"
        else:
            sort = "n" if g.word(w)[2] >= 0 or any(g.word(p)[0] for p in regex.split("[-'’]", w)) else "o"
        tokens.append((m.start(), m.end(), sort))
    for i, (s, e, sort) in enumerate(tokens):
        if sort == "x":
            continue
        words, at, j, form, got = [] if sort == "i" else [text[s:e]], e, i + 1, "i" if sort == "i" else "p", []
        while j < len(tokens) and tokens[j][2] in "in" and j - i < 5:
            gap = _GAP.fullmatch(text, at, tokens[j][0])
            if gap is None:
                break
            at = tokens[j][1]
            if tokens[j][2] == "i":
                if len(words) > 1 or gap["particle"]:
                    break
                form = "i"
            else:
                words.append(text[tokens[j][0] : at])
                if len(words) < 3 or all(g.word(p)[0] for p in words):
                    got.append(_name(text, s, at, words, form, i, j, tokens, g))
                if len(words) == 3 or gap["particle"]:
                    break
            j += 1
        if len(words) == 2 or not (sort == "o" or sort == "n" and not g.word(text[s:e])[0] and _START.search(text, max(0, s - 8), s)):
            yield from got
        j = i + 1  # family name, comma, given names
        if sort == "n" and j < len(tokens) and tokens[j][2] in "in" and _COMMA.fullmatch(text, e, tokens[j][0]):
            lead = _LEAD.search(text, max(0, s - 12), s)
            words = [text[s:e]] + ([] if tokens[j][2] == "i" else [text[tokens[j][0] : tokens[j][1]]])
            while j + 1 < len(tokens) and tokens[j + 1][2] == "i" and _GAP.fullmatch(text, tokens[j][1], tokens[j + 1][0]):
                j += 1
            yield _name(text, lead.start() if lead else s, tokens[j][1], words, "c", i, j, tokens, g)


def _name(text: str, s: int, e: int, words: list[str], form: str, i: int, j: int, tokens: list, g: Gazetteer) -> Span:
    parts = [g.word(p) for w in words for p in _LETTERS.findall(w) if len(p) > 2]
    known = sum(p[0] for p in parts)
    scores = [p[1] for p in parts if not p[0] or p[1] > 0.3][tokens[i][2] == "o" and len(parts) > 1 :]
    letters = 0 if not scores else 1 if min(scores) > 0.3 else -1 if min(scores) < -0.3 else 0
    written = min((p[2] for p in parts if not p[0]), default=0)
    before, after = text[max(0, s - 24) : s], text[e : e + 24]
    thing = -1 if _THING_AFTER.match(after) or _THING_BEFORE.search(before) else 0
    longer = 0
    if letters < 1:  # else the words around need not be part of it
        if i and tokens[i - 1][2] in "no" and not _START.search(text, max(0, tokens[i - 1][0] - 8), tokens[i - 1][0]) and _GAP.fullmatch(text, tokens[i - 1][1], tokens[i][0]):
            longer = -1
        if j + 1 < len(tokens) and tokens[j + 1][2] in "no" and _GAP.fullmatch(text, tokens[j][1], tokens[j + 1][0]):
            longer = -1
    cue = 1 if _NAME_CUE.search(before) or _MAIL_NEXT.match(after) else 0
    votes = 1 if known else 0, 1 if known == len(parts) > 1 else 0, letters, written, thing, longer, cue
    return Span(s, e, "name", text[s:e], votes, f"{form}{len(words)}{'u' if text[s:e].isupper() else ''}|{_side(text, s - 1)}|{_side(text, e)}")


def spans(text: str, g: Gazetteer) -> list[Span]:
    """All candidates of a text with their votes and form."""
    low = text.lower()
    return [x for kind in KINDS[:4] for x in _values(text, kind, low)] + list(_names(text, g))


def features(kind: str, votes: tuple[int, ...], form: str, blank: bool = False) -> list[int]:
    """Buckets of a candidate's features: votes cast, and its form with the characters around. blank: of the value only."""
    sort = "name" if kind == "name" else "value"
    shape, left, right = form.split("|")
    say = len(votes) - (CONTEXT[sort] if blank else 0)
    got = [kind, f"{kind}|f{shape}", *(f"{kind}|v{i}{v}" for i, v in enumerate(votes[:say]) if v)]
    if not blank:
        got += [f"{kind}|l{left}", f"{kind}|r{right}"]
    return [zlib.crc32(f.encode()) % BUCKETS for f in got]


@dataclass
class LabelModel:
    """Per kind the share of true candidates and, of each labeler, the probabilities of its votes given the truth, among
    those it votes on: abstaining says nothing."""

    prior: dict[str, float]
    table: dict[str, np.ndarray]

    @staticmethod
    def fit(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 200) -> LabelModel:
        """Expectation-maximisation over vote patterns. It starts from the balance of votes; a labeler's tables keep a
        prior that a vote speaks for what it says, so that the two classes cannot change places."""
        prior, table = {}, {}
        for kind in KINDS:
            rows = [(v, n) for (k, v), n in counts.items() if k == kind]
            if not rows:
                continue
            votes, n = np.array([v for v, _ in rows]), np.array([n for _, n in rows], float)
            y = 1 / (1 + np.exp(-2.0 * (votes.sum(1) - 0.5)))
            for _ in range(rounds):
                p = float(np.clip((n * y).sum() / n.sum(), 0.01, 0.5))
                t = np.ones((votes.shape[1], 3, 2))
                for j in range(votes.shape[1]):
                    cast = votes[:, j] != 0
                    agree = 0.1 * n[cast].sum() + 2
                    for vote in (-1, 1):
                        on = votes[:, j] == vote
                        t[j, vote + 1, 1] = (n * y)[on].sum() + (agree if vote == 1 else 0.1 * agree)
                        t[j, vote + 1, 0] = (n * (1 - y))[on].sum() + (agree if vote == -1 else 0.1 * agree)
                    t[j, [0, 2]] /= t[j, [0, 2]].sum(0)
                new = LabelModel({kind: p}, {kind: t})._given(kind, votes)
                done = np.abs(new - y).max() < 1e-5
                y = new
                if done:
                    break
            prior[kind], table[kind] = p, t
        return LabelModel(prior, table)

    def _given(self, kind: str, votes: np.ndarray) -> np.ndarray:
        t, p = self.table[kind], self.prior[kind]
        odds = math.log(p / (1 - p)) + sum(np.log(t[j, votes[:, j] + 1, 1] / t[j, votes[:, j] + 1, 0]) for j in range(votes.shape[1]))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def probability(self, kind: str, votes: tuple[int, ...]) -> float:
        return float(self._given(kind, np.array([votes]))[0]) if kind in self.prior else 0.0


def train(rows: list[tuple[list[int], float, float]], rounds: int = 400, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression on (features, probability, weight), by full-batch AdaGrad."""
    w = np.zeros(BUCKETS)
    if not rows:
        return w
    size = np.array([len(f) for f, _, _ in rows])
    flat, owner = np.concatenate([f for f, _, _ in rows]), np.repeat(np.arange(len(rows)), size)
    y, n, seen = np.array([p for _, p, _ in rows]), np.array([c for _, _, c in rows], float), np.full(BUCKETS, 1e-8)
    n /= n.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[flat], len(rows)), -30, 30)))
        grad = np.bincount(flat, (n * (p - y))[owner], BUCKETS) + decay * w / len(rows)
        seen += grad**2
        w -= rate * grad / np.sqrt(seen)
    return w


#: What the classifier sees of a candidate: (kind, votes, form).
Pattern = tuple[str, tuple[int, ...], str]


def fitted(patterns: dict[Pattern, int]) -> np.ndarray:
    """Classifier weights from the counts of (kind, votes, form) of all candidates."""
    counts: Counter = Counter()
    for (kind, votes, _), n in patterns.items():
        counts[kind, votes] += n
    labels, total = LabelModel.fit(counts), Counter()
    for (kind, _), n in counts.items():
        total[kind] += n
    rows = []
    for (kind, votes, form), n in patterns.items():
        p = labels.probability(kind, votes)
        rows += [(features(kind, votes, form), p, n / total[kind]), (features(kind, votes, form, True), p, n / total[kind])]
    return train(rows)


def odds(patterns: dict[Pattern, int]) -> dict[Pattern, float]:
    """What the classifier says of every pattern there is: its log-odds."""
    w = fitted(patterns)
    return {p: float(w[features(*p)].sum()) for p in patterns}


def _rank(c: dict) -> int:
    """Of names that overlap: plain ones first, but one with a comma before a pair whose letters are not name-like."""
    if c["kind"] != "name":
        return 0
    form, (_, known, letters, *_) = c["form"][0], c["votes"]
    return (1 if letters > 0 else 3) if form == "c" else 2 if form == "p" and letters < 1 and not known else 0


def decided(cands: list, say: dict[Pattern, float]) -> list:
    """Candidates with positive odds, none overlapping, in order. Each has start, end, kind, votes, form."""
    scored = [(c, x) for c in cands if (x := say[c["kind"], tuple(c["votes"]), c["form"]]) > 0]
    # names last, as they can lie in addresses and mail; of addresses and names the longer first
    scored.sort(key=lambda x: (x[0]["kind"] == "name", _rank(x[0]), x[0]["start"] - x[0]["end"] if x[0]["kind"] in ("address", "name") else 0, -x[1], x[0]["start"]))
    taken: list = []
    for c, _ in scored:
        if all(c["end"] <= t["start"] or c["start"] >= t["end"] for t in taken):
            taken.append(c)
    return sorted(taken, key=lambda c: c["start"])


_SPANS = "array<struct<start: int, end: int, kind: string, value: string, votes: array<int>, form: string>>"


def candidates(documents: DataFrame, g: Gazetteer) -> DataFrame:
    """(doc_id, spans) of the documents with any candidate."""
    shared = documents.sparkSession.sparkContext.broadcast(g)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("votes", pa.list_(pa.int32())), ("form", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if got := spans(t, shared.value):
                    ids.append(d)
                    out.append([s.__dict__ for s in got])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, kind)], names=["doc_id", "spans"])

    plain_ = documents.filter("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain_.mapInArrow(run, f"doc_id long, spans {_SPANS}")


#: Words of letters only that are no part of an address, a path or a number.
_WORDS = r"(?<![\p{L}\p{M}\d_.@+'’/-])\p{L}{3,}+(?![\p{L}\p{M}\d_@]|[-.+'’]\p{L})"


def gazetteer(documents: DataFrame, known_names: DataFrame) -> Gazetteer:
    """Known names, nulls left out, and what the documents' words say: a word counts once a document. Without any names
    the letter model says nothing useful and the gazetteer nothing. Raises ValueError where the names are more than a
    broadcast may hold."""
    size = known_names.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    if size > BROADCAST_LIMIT:
        raise ValueError(f"{size >> 20} MB of names; a gazetteer of at most {BROADCAST_LIMIT >> 20} MB goes to every task")
    runs = documents.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0)))).alias("w")).withColumn("word", F.lower("w"))
    words = runs.groupBy("word").agg(F.count_if(F.col("w") == F.col("word")).alias("small"), F.count_if(F.col("w") == F.initcap("word")).alias("capital"))
    words = written(words, "words")
    level: list[Column] = [F.least(F.lit(255), F.floor(4 * F.log2(1 + F.sum(c)))).cast("int").alias(c) for c in ("small", "capital")]
    slot = [F.pmod(F.crc32(F.encode(F.concat("word", F.lit(mark)), "UTF-8")), F.lit(WORD_SLOTS)) for mark in ("", "#")]
    held = words.select(F.explode(F.array(*slot)).alias("slot"), "small", "capital").groupBy("slot").agg(*level).toPandas()  # at most WORD_SLOTS rows
    counts = {c: np.zeros(WORD_SLOTS, "u1") for c in ("small", "capital")}
    for c, a in counts.items():
        a[held.slot.to_numpy("i8")] = held[c].to_numpy("u1")
    ordinary = words.filter("small > capital").filter(F.col("word").rlike("^[a-z]{4,}$"))
    grams = ordinary.select(F.explode(T.trigrams(F.concat(F.lit("^"), "word", F.lit("$")))).alias("g")).groupBy("g").count().collect()  # at most 28 ** 3
    names = [r.name for r in known_names.filter("name is not null").select("name").distinct().orderBy("name").collect()]
    return Gazetteer(names, {r.g: r["count"] for r in grams}, counts["small"], counts["capital"])


def found(documents: DataFrame, known_names: DataFrame) -> DataFrame:
    """(doc_id, kind, value, start, end), a row a span; start and end count code points. Null and blank texts and
    documents without an id give nothing; equal documents each give their own rows. known_names: (name)."""
    cands = written(candidates(documents, gazetteer(documents, known_names)), "pii")
    patterns = cands.select(F.inline("spans")).groupBy("kind", "votes", "form").count().collect()  # bounded by labelers and forms
    said = documents.sparkSession.sparkContext.broadcast(odds({(r.kind, tuple(r.votes), r.form): r["count"] for r in patterns}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(d, s["kind"], s["value"], s["start"], s["end"]) for d, c in zip(pdf.doc_id, pdf.spans) for s in decided(c, said.value)]
            yield pd.DataFrame(out, columns=["doc_id", "kind", "value", "start", "end"])

    return cands.mapInPandas(run, "doc_id long, kind string, value string, start int, end int")


def redacted(documents: DataFrame, known_names: DataFrame) -> DataFrame:
    """(doc_id, text, replaced): every found span replaced by its placeholder, all else as it was; null texts stay."""
    got = found(documents, known_names).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end", "kind"))).alias("s"))
    rows = documents.filter("doc_id is not null").select("doc_id", "text").join(got, "doc_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, t, found_ in zip(pdf.doc_id, pdf.text, pdf.s):
                parts, at = [], 0
                for s in found_ if found_ is not None and t is not None else ():
                    parts += [t[at : s["start"]], PLACEHOLDER.format(s["kind"])]
                    at = s["end"]
                out.append((d, None if t is None else "".join([*parts, t[at:]]), len(parts) // 2))
            yield pd.DataFrame(out, columns=["doc_id", "text", "replaced"])

    return rows.mapInPandas(run, "doc_id long, text string, replaced int")
