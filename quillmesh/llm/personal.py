"""Problem 5: personal data in free text, replaced by typed placeholders.

Anchor expansion: one Aho-Corasick pass over a folded copy of the text (lower case, no accents, plain
digits) finds anchors: at-signs, forms of address, given names, endings of family names, identifier and
street cues. A deterministic parser of each kind then expands the anchor to its boundaries and validates
it. Spans are mapped back to the original text.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the name list that are sent to the workers; a longer list is an error, not a silent cut.
NAMES = 200_000
KINDS = ("email", "id_number", "phone", "address", "name")

# Words that lead to a kind, folded to lower case without accents.
TITLES = """mr mrs ms miss mister dr prof professor sir madam herr herrn frau monsieur madame mme mlle m sr sra srta senor senora don dona dra
sig sig.ra sig.na signor signora dott dott.ssa ing avv г-н г-жа г-ца д-р проф инж господин госпожа""".split()
ID_CUES = """passport|social security|social insurance|national insurance|tax id|tax number|tax no|taxpayer|identity card|id card|identity number|ssn|steuernummer|steuer-id|steueridentifikation|personalausweis|reisepass|passnummer|ausweisnummer
sozialversicherung|rentenversicherung|carte d'identite|carte d’identite|passeport|securite sociale|numero fiscal|identifiant fiscal|numero d'identification|dni|nif|nie|pasaporte|documento de identidad|carnet de identidad
seguridad social|identificacion fiscal|codice fiscale|carta d'identita|carta d’identita|passaporto|previdenza sociale|assicurazione sociale|numero di identificazione|егн|лична карта|личната карта|личната ми карта|паспорт|данъчен номер|данъчния|осигурителен|осигурителния""".replace("\n", "|").split("|")
PHONE_CUES = """call|phone|tel|mobile|cell|text me|reach|ring|fax|plumber|anruf|telefon|handy|zuruckrufen|erreichen|appel|rappeler|telephone|repond|llamar|telefono|movil|contesta|chiam|richiamare|cellulare|risponde|обадя|телефон|отговаря|звънна|моби""".split("|")
_STREET_EN = "street|st|road|rd|lane|ln|ave|avenue|blvd|boulevard|drive|crescent|court|place|square|way|close|terrace|gardens|mews|hill|row"
_STREET_DE = "straße|strasse|str\\.|weg|platz|allee|gasse|ring|damm|ufer|chaussee|steig"
_STREET_FR = "rue|avenue|av\\.|bd\\.?|boulevard|place|chemin|impasse|allee|quai|route|cours|square|passage|faubourg"
_STREET_ES = "calle|c/|avda\\.?|avenida|plaza|paseo|camino|ronda|carretera|travesia"
_STREET_IT = "via|viale|piazza|piazzale|corso|largo|vicolo|strada|vle\\.?|p\\.za"
_STREET_BG = "ул\\.|улица|бул\\.|булевард|ж\\.к\\.|ж\\. ?к\\.|пл\\.|площад|кв\\."

# Anchors that gate the parsers.
_AT_WORDS = ("@", "(at)", "[at]", "{at}", "<at>", " at ", "_at_", "-at-", "(a)", "arroba", "chiocciola", "arobase", "klammeraffe", "(ät)", "(ат)", "кльомба", "маймуна")
#: Street cues with the numbers of the patterns in ADDRESSES that they can be part of.
_STREETS = (
    ([f" {w}" for w in _STREET_EN.split("|")], (0,)),
    (["straße", "strasse", "str.", "weg", "platz", "allee", "gasse", "ring", "damm", "ufer", "chaussee", "steig"], (1, 2)),
    ([f"{w} " for w in ("am", "an der", "an dem", "im", "zum", "zur", "auf der", "auf dem", "unter den", "hinter der")], (3,)),
    (["rue ", "avenue ", "av. ", "bd ", "bd. ", "boulevard ", "place ", "chemin ", "impasse ", "allee ", "quai ", "route ", "cours ", "square ", "passage ", "faubourg "], (4,)),
    (["calle ", "c/", "avda", "avenida ", "plaza ", "paseo ", "camino ", "ronda ", "carretera ", "travesia "], (5,)),
    (["via ", "viale ", "piazza", "corso ", "largo ", "vicolo ", "strada ", "vle", "p.za"], (6,)),
    (["ул.", "улица ", "бул.", "булевард ", "ж.к.", "ж. к.", "пл.", "площад ", "кв."], (7,)),
)

_W = r"[^\W\d_]"
_GAP = r"(?:[ \t]*\r?\n>?[ \t]*|[ \t]+)"
_AT = r"(?:[ \t]?[\[({<][ \t]*(?:@|at|a|ät|ат)[ \t]*[\])}>][ \t]?|[ \t]?@[ \t]?|[ \t]+(?:arroba|chiocciola|arobase|klammeraffe|кльомба|маймуна)[ \t]+|[_\-]at[_\-])"
_DOT = r"(?:\.|[ \t]?[\[({][ \t]*(?:\.|dot|punkt|punto|point|точка)[ \t]*[\])}][ \t]?|[ \t]+(?:dot|punkt|punto|point|точка)[ \t]+)"
_DOTWORD = r"(?:[ \t]?[\[({][ \t]*dot[ \t]*[\])}][ \t]?|[ \t]+(?:dot|punkt|punto|point|точка)[ \t]+)"
_LOCAL = r"(?<![\w.+\-])[\w](?:[\w.+\-'%]*[\w])?"
_LABEL = r"[^\W_](?:[\w\-]*[^\W_])?"
EMAIL = re.compile(rf"(?:mailto:)?(?:{_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}{_W}{{2,12}}|{_LOCAL}{_GAP}at{_GAP}{_LABEL}(?:{_DOTWORD}{_LABEL})*{_DOTWORD}{_W}{{2,12}})(?![\w@])")
_FILES = re.compile(r"\.(?:png|jpe?g|gif|svg|webp|pdf|ico|css|js|txt|md|html?)$")

_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"(?:\+|\()?\d[\d ().\-/‐‑– ]{5,24}\d")
_PHONES = tuple(
    re.compile(p)
    for p in (
        r"\+\d{1,3}[ .\-/]?(?:\(\d{1,4}\)[ .\-/]?)?\d{1,9}(?:[ .\-/]\d{1,9}){0,6}",
        r"00[1-9]\d{0,2}[ .\-/](?:\(?\d{1,4}\)?[ .\-/])?\d{2,9}(?:[ .\-/]\d{1,9}){0,5}",
        r"(?:1[ .\-])?\(?[2-9]\d{2}\)?[ .\-]\d{3}[ .\-]\d{4}",
        r"\(?0\d{1,5}\)?(?:[ .\-/]{1,2}\d{2,8}){1,5}",
        r"\(?0\d{1,4}\)[ ]?\d{2,5}[ \-]\d{3,6}",
        r"[679]\d{2}[ .\-]\d{3}[ .\-]\d{3}",
        r"[679]\d{2}(?:[ .\-]\d{2}){3}",
    )
)
#: A plain run of digits is a phone number right behind a cue.
_CUED = re.compile(r"(?:'s)?(?:[ \t]+(?:me|us|no|nr|number|numero|nummer|номер|is|at|on|au|al|auf|unter|на))*[ \t]*[.:]*[ \t]*(\+?\d{8,15})(?![\w@.,/\-]*\d)")
_LOCAL_PHONE = re.compile(r"[2-9]\d{2}[ .\-]\d{4}")
_DATE = re.compile(r"\d{1,2}([./\-])\d{1,2}\1\d{4}")
_NOT_PHONE = re.compile(r"(?:isbn|issn|ref|sn|eur|usd|gbp|v|p\.|pp\.|s\.|#|№|nr|no|id|=|sha|job|order|invoice|€|\$|£)[ :.#]*$")

_ID = re.compile(
    r"(?<![\w])(?:[a-zа-я]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-zа-я]|[a-z]{6} ?\d{2} ?[a-z] ?\d{2} ?[a-z] ?\d{3} ?[a-z]|\d{1,4}(?:[ .\-/]\d{1,6}){2,8}(?:[ \-]?[a-z])?|[a-z]{0,3}\d{5,14}(?:-?[a-z]{1,2})?|(?=[a-z]*\d[a-z]*\d)[a-z\d]{8,14})(?![\w])"
)
#: Abbreviations of "number", whose stop ends no sentence.
_ABBREVIATED = re.compile(r"\b(?:no|nr|num|n)\.")
_NAME_WORD = rf"{_W}[\w’'\-]*"
_HOUSE = r"\d{1,4}[a-zа-я]?(?![\w.,/\-]*\d{4,})"
ADDRESSES = tuple(
    re.compile(p)
    for p in (
        rf"(?:(?:flat|apt|apartment|unit|suite) \d{{1,4}}[a-z]?,{_GAP})?(?<![\w.,\-/#])\d{{1,5}}[a-z]?,?{_GAP}(?P<n>{_NAME_WORD}(?:{_GAP}{_NAME_WORD})?){_GAP}(?:{_STREET_EN})\b\.?(?:,?{_GAP}(?:apt|apartment|suite|unit|flat|#)\.?{_GAP}\d{{1,4}})?(?:,{_GAP}{_NAME_WORD}(?:,?{_GAP}\d{{5}})?)?",
        rf"(?P<n>\b{_W}{{3,}})(?:{_STREET_DE}){_GAP}{_HOUSE}\b(?:,{_GAP}\d{{4,5}}{_GAP}{_NAME_WORD}|{_GAP}in{_GAP}{_NAME_WORD}|,{_GAP}{_NAME_WORD})?",
        rf"(?P<n>\b{_W}+)(?:er|-){_GAP}?(?:straße|strasse|platz|allee|weg){_GAP}{_HOUSE}\b",
        rf"\b(?:am|an der|an dem|im|zum|zur|auf der|auf dem|unter den|hinter der){_GAP}(?P<n>{_NAME_WORD}){_GAP}{_HOUSE}\b,{_GAP}(?:\d{{4,5}}{_GAP})?{_NAME_WORD}",
        rf"(?<![\w.,\-/#])\d{{1,4}}(?:{_GAP}?(?:bis|ter|quater|[a-d]))?,?{_GAP}(?:{_STREET_FR}){_GAP}(?:(?:de|du|des|de la|de l'|d'){_GAP}?)?(?P<n>{_NAME_WORD})(?:,{_GAP}(?:\d{{5}}{_GAP})?{_NAME_WORD}|{_GAP}(?:a|à){_GAP}{_NAME_WORD})?",
        rf"(?<!\w)(?:{_STREET_ES}){_GAP}?(?:(?:de la|de los|de las|del|de){_GAP})?(?P<n>{_NAME_WORD}(?:{_GAP}{_NAME_WORD})?),?{_GAP}(?:n[.ºo°]*{_GAP}?)?{_HOUSE}\b(?:,{_GAP}\d{{1,2}}[ºª°o](?:{_GAP}[a-z]\b)?)?(?:,{_GAP}(?:\d{{5}}{_GAP})?{_NAME_WORD})?",
        rf"(?<!\w)(?:{_STREET_IT}){_GAP}(?:(?:della|delle|dei|degli|del|di|san|santa){_GAP})?(?P<n>{_NAME_WORD}(?:{_GAP}{_NAME_WORD})?),?{_GAP}(?:n[.ºo°]*{_GAP}?)?{_HOUSE}\b(?:,{_GAP}(?:\d{{5}}{_GAP})?{_NAME_WORD}|{_GAP}a{_GAP}{_NAME_WORD})?",
        rf"(?<!\w)(?:{_STREET_BG}){_GAP}?[„\"]?(?P<n>{_NAME_WORD}(?:{_GAP}{_NAME_WORD})?)[“\"]?,?{_GAP}(?:(?:№|no|бл\.|номер|n){_GAP}?)?{_HOUSE}\b(?:,{_GAP}(?:ет|вх|ап|бл)\.{_GAP}?\w{{1,3}})*(?:,{_GAP}{_NAME_WORD})?",
    )
)


def _fold_table() -> dict[int, str]:
    t = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {0xA0: " ", 0x202F: " ", 0x2007: " ", 0x2009: " ", 0x3000: " ", 0x2010: "-", 0x2011: "-"}
    for c in range(0xC0, 0x250):
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) > 1:
            t[c] = d[0].lower()
    return t


_FOLD = _fold_table()
#: Characters that a reader doesn't see, and accents that stand by themselves.
_UNSEEN = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u2060\ufeff]")


def folded(text: str) -> tuple[str, list[int] | None]:
    """A lower-case copy without accents and with plain digits; the places of its characters, where they differ."""
    if text.isascii():
        return text.lower(), None
    if not _UNSEEN.search(text):
        low = text.translate(_FOLD).lower()
        if len(low) == len(text):
            return low, None
    out, at = [], []
    for i, ch in enumerate(text):
        if unicodedata.category(ch) in ("Mn", "Cf"):
            if ch == "\u0306" and out and out[-1] == "и":
                out[-1] = "й"
            continue
        low = ch.translate(_FOLD).lower()
        for x in low:
            out.append(x)
            at.append(i)
    at.append(len(text))
    return "".join(out), at


class Names:
    """Given names and a rule for family names, made of the list: a beginning and an ending that several of its names share."""

    def __init__(self, given: Iterable[str], family: Iterable[str]):
        self.given = {folded(g)[0] for g in given}
        families = sorted({folded(f)[0] for f in family})
        ends, begins = defaultdict(set), defaultdict(set)
        for n in families:
            for i in range(3, len(n) - 2):
                ends[n[i:]].add(n[:i])
                begins[n[:i]].add(n[i:])
        ends = {e: b for e, b in ends.items() if len(b) >= 4}
        begins = {b: {e for e in es if e in ends} for b, es in begins.items()}
        begins = {b: es for b, es in begins.items() if len(es) >= 3}
        ends = {e for e, bs in ends.items() if sum(b in begins for b in bs) >= 3}
        parts = [f"(?:{'|'.join(sorted(map(re.escape, x), key=lambda s: (-len(s), s)))})" for x in (begins, ends)]
        whole = "|".join(sorted(map(re.escape, families), key=lambda s: (-len(s), s)))
        rule = "|".join(x for x in (whole, "".join(parts) if begins and ends else "") if x)
        self.family = re.compile(rf"(?:{rule})") if rule else None
        self.anchors = sorted(ends | {f[-4:] for f in families})
        self.seen: dict[str, bool] = {}

    def is_family(self, word: str) -> bool:
        """Whether the rule or the list has this folded word."""
        known = self.seen.get(word)
        if known is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            known = self.seen[word] = bool(self.family and self.family.fullmatch(word))
        return known


_TITLE = "|".join(sorted((re.escape(t) for t in TITLES), key=len, reverse=True))
_BEFORE = re.compile(rf"(?P<title>(?<![\w])(?:{_TITLE})\.?{_GAP})?(?P<given>(?<![\w@.+]){_W}[\w’'\-]+,?{_GAP})?(?P<initial>(?:(?<!\w){_W}\.[\- ]?{_GAP}?)+)?$")
_AFTER = re.compile(rf",?{_GAP}(?P<given>{_W}[\w’'\-]+)")
#: Beside a listed given name or a form of address, which are anchors themselves: initials and further given names, then the family name.
_FAMILY_AFTER = re.compile(rf"(?:{_GAP}(?:{_W}\.[\- ]?)+)?{_GAP}(?P<family>{_W}(?:[\w’'\-]*\w)?)(?![\w@])")
_FAMILY_BEFORE = re.compile(rf"(?<![\w@.+\-’'/])(?P<family>{_W}(?:[\w’'\-]*\w)?),{_GAP}$")
_AFTER_COMMA = re.compile(rf",{_GAP}?(?:(?P<given>{_W}[\w’'\-]+)|(?P<initial>{_W}\.))(?![\w@])")


class Finder:
    def __init__(self, given: Iterable[str], family: Iterable[str]):
        self.names = Names(given, family)
        groups: dict[str, dict[str, tuple]] = defaultdict(dict)
        for kind, words in (("email", _AT_WORDS), ("id_number", ID_CUES), ("name", self.names.anchors), ("given", self.names.given), ("title", TITLES)):
            for w in words:
                groups[w][kind] = ()
        for w in PHONE_CUES:
            groups[w]["phone"] = ()
        for words, numbers in _STREETS:
            for w in words:
                groups[w]["address"] = groups[w].get("address", ()) + numbers
        a = ahocorasick.Automaton()
        for w, kinds in groups.items():
            a.add_word(w, (w, kinds))
        a.make_automaton()
        self.anchors = a

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) in the text, in order, without overlaps; kinds earlier in KINDS win."""
        s, at = folded(text)
        mail, cues, calls, streets, families, listed = False, [], [], [], [], []
        for end, (word, kinds) in self.anchors.iter(s):
            after = s[end + 1 : end + 2]
            if "email" in kinds:
                mail = True
            if "name" in kinds and not after.isalnum() and after != "@":
                families.append(end + 1)
            if ("given" in kinds or "title" in kinds) and not (after.isalnum() or after == "@" or end >= len(word) and (s[end - len(word)].isalnum() or s[end - len(word)] in "@_")):
                listed.append((end + 1 - len(word), end + 1, "given" in kinds))
            if "address" in kinds and _DIGIT.search(s, max(0, end - 45), end + 50):
                streets.append((end + 1, kinds["address"]))
            if "phone" in kinds and not after.isalnum():
                calls.append(end + 1)
            if "id_number" in kinds and not (len(word) < 5 and (after.isalnum() or end >= len(word) and s[end - len(word)].isalnum())):
                cues.append(end + 1)
        taken: list[tuple[int, int, str]] = []
        covered = bytearray(len(s))

        def free(a: int, b: int) -> bool:
            """Whether no span reaches into [a, b), which is taken then."""
            if covered.find(1, a, b) >= 0:
                return False
            covered[a:b] = b"\x01" * (b - a)
            return True

        if mail:
            for m in EMAIL.finditer(s):
                if not _FILES.search(m.group()) and free(*m.span()):
                    taken.append((*m.span(), "email"))
        for c in cues:
            for m in _ID.finditer(s, c, min(len(s), c + 90)):
                between = _ABBREVIATED.sub("", s[c : m.start()])
                digits = sum(x.isdigit() for x in m.group())
                if digits < 4 or digits < 6 and m.group().isdigit() or re.search(r"[!?;|]|[.]\s|\n\s*\n", between):
                    continue
                if free(*m.span()):
                    taken.append((*m.span(), "id_number"))
                break
        for m in _NUMBER.finditer(s):
            if (span := self._phone(s, m)) and free(*span):
                taken.append((*span, "phone"))
        for c in calls:
            if (m := _CUED.match(s, c, min(len(s), c + 60))) and free(*m.span(1)):
                taken.append((*m.span(1), "phone"))
        for end, numbers in streets:
            for number in numbers:
                for m in ADDRESSES[number].finditer(s, max(0, end - 70), min(len(s), end + 90)):
                    n = m.start("n")
                    o = text[at[n] if at else n]
                    if m.start() < end <= m.end() and (o.isupper() or o.istitle()) and free(*m.span()):
                        taken.append((*m.span(), "address"))
        for end in dict.fromkeys(families):
            start = end
            while start and (s[start - 1].isalpha() or s[start - 1] == "-"):
                start -= 1
            if self.names.is_family(s[start:end]) and not (start and s[start - 1] in "@.+_" and s[start - 2 : start - 1].isalnum() and s[start - 1] != "."):
                if (span := self._name(s, text, at, start, end)) and free(*span):
                    taken.append((*span, "name"))
        for start, end, given in listed:
            if (span := self._beside(s, text, at, start, end, given)) and free(*span):
                taken.append((*span, "name"))
        return sorted((at[a] if at else a, (at[b - 1] + 1 if at else b), k) for a, b, k in taken)

    @staticmethod
    def _phone(s: str, m: re.Match) -> tuple[int, int] | None:
        a, b = m.span()
        if s[a] != "+" and a and (s[a - 1].isalnum() or s[a - 1] in ".,/#@:=_-" and not (s[a - 1] in ":.," and a > 1 and s[a - 2].isalpha())):
            return None
        if b < len(s) and (s[b].isalnum() or s[b] in "@=_" or s[b] in ",./:-" and b + 1 < len(s) and s[b + 1].isdigit()):
            return None
        raw = re.sub(r"[‐‑–]", "-", s[a:b])
        if raw[0] == "(" and ")" not in raw or _DATE.match(raw) or _NOT_PHONE.search(s[max(0, a - 9) : a]):
            return None
        raw = re.sub(r"\((0)\)[ ]?", r"(\1)", re.sub(r" +", " ", raw))
        n = len(re.sub(r"\D", "", raw))
        if 8 <= n <= 15 and any(p.fullmatch(raw) or p.fullmatch(raw.replace("(0)", "")) for p in _PHONES):
            return a, b
        if _LOCAL_PHONE.fullmatch(raw):
            near = s[max(0, a - 40, s.rfind("\n", max(0, a - 40), a)) : a]
            if raw.startswith("555") or any(c in near for c in PHONE_CUES):
                return a, b
        return None

    def _name(self, s: str, text: str, at: list[int] | None, a: int, b: int) -> tuple[int, int] | None:
        lo = max(0, a - 48)
        before = _BEFORE.search(s, lo, a)
        after = _AFTER_COMMA.match(s, b, min(len(s), b + 40))
        start, end = a, b
        known = False
        if before:
            if before["initial"]:
                known, start = True, before.start("initial")
            if before["given"]:
                word = re.match(rf"{_W}[\w’'\-]+", before["given"]).group()
                g = before.start("given")
                o = text[at[g] if at else g]
                plain = "," not in before["given"]
                if word in self.names.given:
                    known, start = True, g
                elif plain and o.isupper() and word not in self._SMALL and not re.search(r"[.!?\n]", s[g + len(word) : a].replace(">", "")):
                    known, start = True, g
            if before["title"] and (known or not before["given"]):
                known, start = True, before.start("title")
        if after and (after["initial"] or after["given"] in self.names.given or text[at[after.start("given")] if at else after.start("given")].isupper() and not known):
            known, end = True, after.end()
        elif not known and (x := _AFTER.match(s, b, min(len(s), b + 30))) and x["given"] in self.names.given:
            known, end = True, x.end()
        return (start, end) if known else None

    def _beside(self, s: str, text: str, at: list[int] | None, a: int, b: int, given: bool) -> tuple[int, int] | None:
        """The name that a listed given name or a form of address at [a, b) is part of; its family name may be unknown, but is written as a name."""

        def shown(i: int, j: int) -> str:
            return text[at[i] : at[j - 1] + 1] if at else text[i:j]

        def named(m: re.Match) -> bool:
            w = shown(*m.span("family"))
            return len(w) > 2 and w[0].isupper() and (w.isupper() or not w[1:].isupper()) and m["family"] not in self._SMALL

        own = shown(a, b)
        if given and not own[0].isupper():
            return None
        m = _FAMILY_AFTER.match(s, b + (s[a:b] not in self._FULL and not given and s[b : b + 1] == "."), min(len(s), b + 60))
        if m and not given and m["family"] in self.names.given:
            m = _FAMILY_AFTER.match(s, m.end(), min(len(s), m.end() + 60)) or m
        if m and named(m):
            before = _BEFORE.search(s, max(0, a - 48), a) if given else None
            return before.start("title") if before and before["title"] and not before["given"] and not before["initial"] else a, m.end()
        if given and (m := _FAMILY_BEFORE.search(s, max(0, a - 40), a)) and named(m):
            return m.start(), b
        return None

    #: Forms of address that aren't abbreviations; a stop behind them ends the sentence.
    _FULL = frozenset("miss mister professor sir madam herr herrn frau monsieur madame senor senora don dona signor signora господин госпожа".split())
    #: Words before a lone family name that are no given name.
    _SMALL = frozenset("with from by to for the and of in at bei mit von und der die das für aus avec de chez et pour la le les con di da per e il lo y el los para с от при за и на".split())

    def mask(self, text: str) -> tuple[str, list[str]]:
        out, last, kinds = [], 0, Counter()
        for a, b, kind in self.spans(text):
            out += [text[last:a], f"[{kind.upper()}]"]
            last = b
            kinds[kind] += 1
        return "".join([*out, text[last:]]), sorted(kinds)


def mask_personal(rows: DataFrame, names: DataFrame, text: str, keep: tuple[str, ...], with_text: bool = True) -> DataFrame:
    """The rows' `keep` columns, the masked text (if asked for) and the kinds found; every row comes out once.

    Null texts stay null with no kinds, empty ones stay empty. Texts are read whole. The name list is a
    stated table of fixed size (at most NAMES entries); names outside of it are recognised by its rule.
    """
    listed = names.select("name", "kind").where(F.col("name").isNotNull() & (F.trim("name") != "")).distinct().limit(NAMES + 1).collect()
    if len(listed) > NAMES:
        raise ValueError(f"more than {NAMES} names; give a smaller list")
    given = [r["name"].strip() for r in listed if r["kind"] == "given"]
    family = [r["name"].strip() for r in listed if r["kind"] != "given"]
    sent = rows.sparkSession.sparkContext.broadcast((given, family))
    picked = rows.select(*keep, F.col(text).alias("t_"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    schema = f"{fields}, " + ("masked string, " if with_text else "") + "kinds array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(*sent.value)
        for batch in batches:
            masked, kinds = [], []
            for value in batch.column(len(keep)):
                t = value.as_py()
                if not t:
                    masked.append(t), kinds.append([])
                elif with_text:
                    m, k = finder.mask(t)
                    masked.append(m), kinds.append(k)
                else:
                    kinds.append(sorted({k for _, _, k in finder.spans(t)}))
            columns = [*batch.columns[: len(keep)], *([pa.array(masked, pa.string())] if with_text else []), pa.array(kinds, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(["masked"] if with_text else []), "kinds"])

    return picked.mapInArrow(run, schema)
