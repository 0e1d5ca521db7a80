"""Candidates for personal information, and what each labeler says of them.

``candidates(text, known)`` gives every span that may be personal information of
some kind, with one vote of each of the kind's labelers: ``+``, ``-`` or ``0``
(abstains).  Labelers are formats (regular expressions), gazetteers (known names)
and contexts (words before and after).  What is no span of a kind by its form is no
candidate; whether a candidate is real no labeler decides, see ``pii``.

The words of a text are cut once; which searches a text is worth is told by them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

_L = r"[^\W\d_]"
EMAIL, PHONE, ID, ADDRESS, NAME = range(5)
KINDS = ("email", "phone", "id_number", "address", "name")
#: Characters of context that labelers see on each side.
CONTEXT = 48


class Candidate(NamedTuple):
    kind: int
    start: int
    end: int
    votes: str
    #: Two parts whose company in the corpus tells: given and family name, house number and street.
    one: str | None = None
    two: str | None = None


class Known(NamedTuple):
    """Lower-case names; endings: the last word of each family name."""

    given: frozenset[str]
    family: frozenset[str]
    endings: frozenset[str]
    #: Given names and endings.
    all: frozenset[str]

    @classmethod
    def of(cls, given: Iterable[str], family: Iterable[str]) -> Known:
        family = frozenset(family)
        given, endings = frozenset(given), frozenset(re.findall(rf"{_L}{{2,}}", f)[-1] for f in family if re.search(rf"{_L}{{2,}}", f))
        return cls(given, family, endings, given | endings)


def _vote(yes: bool, no: bool = False) -> str:
    return "-" if no else "+" if yes else "0"


def _rx(s: str, flags: int = re.I) -> re.Pattern:
    return re.compile(s, flags)


def _words(*lists: str) -> frozenset[str]:
    return frozenset(" ".join(lists).split())


#: Runs of letters, of which a text's words are made.
WORD = re.compile(rf"{_L}{{2,}}")
_LAST, _FIRST = re.compile(r"\w+$"), re.compile(r"\w+")
_OPEN, _SHUT = " \t\r\n:=\"'(<[{,*#|>/-–—", " \t\r\n\"')>]},;:"


_ARTICLES = frozenset(("der", "dem", "den", "die", "das", "the", "la", "le", "el", "los", "las", "les"))


def _before(t: str, a: int, articles: bool = True) -> str:
    """The last word before a place, lower-cased, whatever marks stand between; the one before if it is an article and these don't count."""
    m = _LAST.search(left := t[max(0, a - CONTEXT) : a].rstrip(_OPEN + "."))
    if m and not articles and m[0].lower() in _ARTICLES:
        m = _LAST.search(left[: m.start()].rstrip(_OPEN + ".")) or m
    return m[0].lower() if m else ""


def _after(t: str, b: int) -> str:
    m = _FIRST.match(t[b : b + CONTEXT].lstrip(_SHUT + "."))
    return m[0].lower() if m else ""


# ---- words that tell.  Fixed values: common words of English, German, Spanish and French

_TITLES = _words("mr mrs ms miss sir dr doctor prof professor", "herr herrn frau", "señor señora sr sra don doña", "monsieur madame mademoiselle mme mlle m me maître")
#: Words that stand before a person: roles, salutations and closings.
_PERSON = _words(
    "contact holder owner user client customer name who signed approved reviewed regards sincerely thanks attn attention dear hi hello colleague trader analyst manager author assignee reporter applicant tenant employee patient",
    "kunde kundin kontakt inhaber inhaberin freigabe gezeichnet unterzeichnet gruß grüße grüßen lieber liebe hallo name kollege kollegin mitarbeiter mitarbeiterin benutzer",
    "titular cliente contacto firmado saludos saludo hola nombre usuario compañero compañera según",
    "titulaire client cliente contact signé cordialement bonjour nom utilisateur collègue selon",
)
#: Words that often stand before a person, and before much else.
_MAYBE_PERSON = _words(
    "by from with for to of and as ask asked tell told call called reach see met thank via cc owe say says said if that but best cheers per",
    "von bei mit an für laut und durch hat fragt fragen wurde dass ob",
    "por de con para y que a cerró pide contó llama pregunta",
    "par de avec pour et que chez à demande appelle soldée",
)
#: Words that stand after a person.
_DOES = _words(
    "said says asked asks wants wrote writes called calls reported reports confirmed confirms noted notes will has had is was restarted closed opened signed approved doubts thinks told tells mentioned requested sent replied moved can did broke about",
    "hat ist war sagt sagte fragt fragte bittet wartet kam meldet schrieb wird möchte will kann zweifelt geschlossen",
    "dijo dice pide pidió ha es está espera escribió llamó quiere no",
    "a dit est attend demande écrit veut relance pense va",
)
#: Words that announce an address.
_HOME = _words(
    "address home house flat office lives live living at to in from deliver delivered delivery ship shipping send sent post moved move parcel courier statement bill invoice near",
    "adresse anschrift lieferanschrift wohnhaft wohne wohnt wohnen büro haus in an lieferung paket rechnung geht umzug ist",
    "dirección domicilio vivo vive casa oficina en a está calle envío paquete factura",
    "adresse domicile habite bureau maison au à le colis envoyer facture est",
)
#: Words before a number that counts something.
_COUNTS = _words(
    "row rows item items step page line lines level levels chapter section order ref seq batch build version trade id gap ts chunk no job window event events obs a the of chunks point route",
    "zeile zeilen seite stufe auftrag kapitel schritt stück ein die",
    "fila filas página nivel orden capítulo paso un la",
    "ligne lignes page niveau ordre chapitre étape un la",
)
#: Words before a phone number.
_CALLS = _words(
    "tel phone telephone mobile cell call ring rang dial dialled text sms pager fax line number reach at on try hotline desk office and or just",
    "is telefon handy nummer unter anschluss erreichbar rückruf mobil fon ruf an ist durchwahl lautet",
    "teléfono tel móvil llámame llama número al en es",
    "téléphone tél portable numéro appelle appelez au est le joignable répond",
)
#: Words before an e-mail address, and before something else with an @.
_WRITES = _words("contact mail email e mailto notify owner smtp reply to reach write writes add cc bcc from or and forward is", "kontakt an schreib schreiben oder und von ist", "correo contacto escribe a y o es", "adresse contact écrire écrivez à ou et est")
_NO_MAIL = _words("ssh scp git rate fill fills sftp rsync")


# ---- e-mail addresses

_AT = _rx(r"@|[\[(]\s?at\s?[\])]")
_SIGN = re.compile("@")
_LOCAL = _rx(r"(?<![\w.+%@-])([^\W_](?:[\w.+%'-]*[\w+%-])?) ?\Z")
_DOMAIN = _rx(r" ?([^\W_][\w-]*(?:(?:\.| ?[\[(]\s?dot\s?[\])] ?)[^\W_][\w-]*)*)")
_DOT = _rx(r"\.| ?[\[(]\s?dot\s?[\])] ?")
_LETTER = re.compile(r"[^\W\d_]")


def _emails(t: str) -> Iterator[Candidate]:
    spelt = any(x in t for x in ("(at", "[at", "( at", "[ at", "(AT", "[AT", "(At", "[At"))
    for m in (_AT if spelt else _SIGN).finditer(t):
        a, b = m.span()
        left = _LOCAL.search(t, max(0, a - 80), a)
        right = _DOMAIN.match(t, b)
        if not left or not right:
            continue
        local, domain = left[1], right[1]
        labels = _DOT.split(domain)
        spaced = t[a - 1] == " " or t[b : b + 1] == " "
        name = _LETTER.search(local) is not None
        end, before = labels[-1], _before(t, left.start(1))
        votes = [
            _vote(len(labels) > 1 and end.isalpha() and len(end) > 1, len(labels) < 2 or end.isdigit()),
            _vote(name and len(local) > 2, not name),
            _vote(before in _WRITES or t[left.start(1) - 1 : left.start(1)] in ("<", "(", '"'), before in _NO_MAIL),
            _vote(len(labels) > 1 and all(_LETTER.search(x) for x in labels), all(x.isdigit() for x in labels)),
            _vote(not spaced or m[0] != "@", end.isdigit() or spaced and m[0] == "@" and not name),
        ]
        yield Candidate(EMAIL, left.start(1), right.end(1), "".join(votes))


# ---- phone numbers

_S = r"[ . ‑‐-]"
_EXT = r"(?:,? ?(?:ext|x|poste|durchwahl|extensión|dw)\.? ?\d{1,5})?"
_PHONE = _rx(
    rf"(?:(?P<intl>\(?\+\d{{1,3}}\)?(?:{_S}?\(?\d{{1,5}}\)?){{2,6}}(?<=\d)|\+\d{{9,14}})"
    rf"|(?P<zeros>00\d{{9,13}}|00{_S}?\d{{1,3}}(?:{_S}\d{{2,6}}){{2,5}})"
    rf"|(?P<us>(?:1{_S})?(?:\(\d{{3}}\){_S}?|\d{{3}}{_S})\d{{3}}{_S}\d{{4}})"
    rf"|(?P<trunk>\(0\d{{1,4}}\){_S}?\d{{3,8}}(?:{_S}\d{{2,6}}){{0,4}}|0\d{{1,5}}(?:[  /-]\d{{2,8}}){{1,5}}|0\d(?:[.  -]\d\d){{4}}|0[67]\d{{8,9}})"
    rf"|(?P<trio>\d{{3}}{_S}\d{{3}}{_S}\d{{3}}|\d{{3}}{_S}\d\d{_S}\d\d{_S}\d\d)){_EXT}(?![\w‑/]|[.,-]\d)"
)
#: Where a phone number may begin: seven digits with nothing but separators between them.
_DIALLED = re.compile(r"[+(\d](?<![\w.+/-][+(\d])(?=(?:(?<=\()\+)?(?:(?<=\d)|\d)(?:[ ()./  ‑‐-]{0,2}\d){6})")
_DATE = re.compile(r"\d\d[/.-]\d\d[/.-]\d{2,4}.*")
_EXT_OF = re.compile(r"(?i)ext|x|poste|durchwahl|dw")


def _phones(t: str, starts: list[int]) -> Iterator[Candidate]:
    """starts: where one may begin."""
    upto = 0
    for at in starts:
        m = _PHONE.match(t, at) if at >= upto else None
        if not m:
            continue
        upto = m.end()
        s = m[0]
        digits = sum(c.isdigit() for c in _EXT_OF.split(s)[0])
        how, before = m.lastgroup, _before(t, m.start())
        counted, ident = before in _COUNTS and before not in _CALLS, before not in _CALLS and _ID_NEAR.search(t, max(0, m.start() - 34), m.start()) is not None
        votes = [
            _vote(how in ("intl", "zeros")),
            _vote(how in ("us", "trunk"), _DATE.fullmatch(s) is not None),
            _vote(9 <= digits <= 14, digits < 8 or digits > 15),
            _vote(before in _CALLS, counted),
            _vote("(" in s or "+" in s or s[0] == "0", counted or ident),
        ]
        yield Candidate(PHONE, m.start(), m.end(), "".join(votes))


# ---- identity numbers

#: Words that announce an identity number.
_ID_WORD = r"(?:passports?|passeport|pasaporte|reisepass|ausweis\w*|personalausweis\w*|dni|nie|nif|cni|ssn|social security|national insurance|ni no|nino|driv(?:er|ing)\W?s? licen[cs]e|licen[cs]e|tax id|steuer\W?id\w*|steueridentifikations\w*|steuernummer|sv\W?nummer|sozialversicherungs\w*|sécurité sociale|nir|permis|permiso|seguridad social|führerschein\w*|carnet|identity|identité|identidad|kyc)"
#: First words of these, by which a text is told to have any.
_ID_WORDS = _words("passport passports passeport pasaporte reisepass dni nie nif cni ssn social national ni nino licence license tax steuer steuernummer sv sécurité nir permis permiso seguridad carnet identity identité identidad kyc")
_ID_STEMS = ("ausweis", "führerschein", "steuerid", "sozialversicherungs", "personalausweis")
_ID_NEAR = _rx(rf"\b{_ID_WORD}\b")
_ID_AFTER = _rx(rf"[\s)\"']*(?:as|als|como|comme) (?:a |an |my )?{_ID_WORD}")
#: An announced number: groups of digits and capitals, each with a digit or one letter long.
_ID_TOLD = _rx(
    rf"\b{_ID_WORD}\.?(?:[\s:=#\"'(,]*\b(?:number|no|nr|n[º°]|nummer|numéro|número|card|code|is|was|are|ist|lautet|es|est|of|de|del|du|with|mit|con|avec)\b\.?){{0,3}}[\s:=#\"'(,]*"
    r"(?P<v>(?-i:(?:[A-Z]{1,2}[ -])?[A-Z]{0,5}\d[A-Z0-9]*(?:[ .-](?:[A-Z0-9]*\d[A-Z0-9]*|[A-Z](?![\w])))*))(?![\w-])"
)
_STRONG = re.compile(r"[A-Z\d](?<![\w.-][A-Z\d])(?:(?<=[A-Z])[A-Z](?:\d{6}[A-D]| \d\d \d\d \d\d [A-D]|-\d{4}-\d{3}-[A-Z])|(?<=[XYZ])-?\d{7}-?[A-Z]|(?<=\d)\d(?:\.\d{3}\.\d{3}-?[A-Z]|\d{6}-?[A-Z]| ?\d{6} ?[A-Z] ?\d{3})|(?<=[A-Z])[A-Z]?\d{7,9}[A-Z]?)(?![\w-])")
_THREE = re.compile(r"\d(?<![\w.+-]\d)\d\d[- ]\d\d[- ]\d{4}(?![\w-]|[.,]\d)")
_WEAK = re.compile(r"\d(?<![\w.+-]\d)(?: ?\d\d ?\d\d ?(?:\d\d|2[AB]) ?\d{3} ?\d{3}(?: ?\d\d)?|\d ?\d{3} ?\d{3} ?\d{3}|\d{8,11})(?![\w-]|[.,]\d)")


def _ids(t: str, starts: list[int], announcing: list[str]) -> Iterator[Candidate]:
    """starts: where rows of digits begin; announcing: words of the text that announce a number."""
    told = bool(announcing)
    spans: dict[tuple[int, int], tuple[bool, bool]] = {m.span(): (True, False) for m in _STRONG.finditer(t)}
    for rx in (_THREE, _WEAK) if told else (_THREE,):
        spans |= {m.span(): (False, False) for at in starts if (m := rx.match(t, at))}
    if told:
        for m in (m for _, at, _ in _places(t, announcing) if (m := _ID_TOLD.match(t, at))):
            if sum(c.isdigit() for c in m["v"]) >= 4 and len(m["v"]) >= 6:
                # Of a form that is known, the number ends where the form does.
                known = next((k for rx in (_STRONG, _THREE, _WEAK) if (k := rx.match(t, m.start("v")))), None)
                span = known.span() if known else m.span("v")
                spans[span] = (spans.get(span, (False, False))[0], True)
    for (a, b), (strong, announced) in spans.items():
        near = announced or told and _ID_NEAR.search(t, max(0, a - 28), a) is not None
        later = told and _ID_AFTER.match(t, b) is not None
        s, before = t[a:b], _before(t, a)
        if not strong and not (near or later or s.count("-") == 2):
            continue
        counted = before in _COUNTS and not announced
        votes = [
            _vote(strong),
            _vote(announced or later, counted),
            _vote(near or later, not (near or later)),
            _vote(_THREE.fullmatch(s) is not None or sum(map(str.isdigit, s)) >= 6, counted),
        ]
        yield Candidate(ID, a, b, "".join(votes))


# ---- street addresses

_WORD = r"[^\W\d_][^\W\d_'’.-]*(?:[-'’][^\W\d_]+)*"
_EN_KINDS = "street|st|road|rd|lane|ln|avenue|ave|drive|dr|court|ct|way|terrace|ter|close|square|sq|boulevard|blvd|place|crescent|row|walk|parade|hill|gardens|mews"
_STREET_EN = _rx(rf"(?<![\w.:,/#@-])(?P<n>\d{{1,5}}[A-Z]?) (?P<s>(?:(?:N|S|E|W|North|South|East|West)\.? )?(?:{_WORD} ){{1,3}}?(?:{_EN_KINDS}))\b(?! (?:street|road|lane|avenue|drive|court|way|terrace)\b)")
_DE_ENDS = "straße|strasse|str\\.|weg|gasse|platz|allee|ufer|damm|ring|steig|steg|pfad|hof|wall|graben|kamp|brücke|markt|chaussee"
_STREET_DE = _rx(rf"(?<![\w-])(?P<s>(?:[^\W\d_]+er (?:ring|straße|strasse|str\.|weg|platz|allee|damm|ufer|gasse|markt|chaussee)|(?:(?:alte[rn]?|neue[rn]?|große[rn]?|kleine[rn]?|obere[rn]?|untere[rn]?|am|an der|zum|zur) )?[^\W\d_]+(?:{_DE_ENDS}))) (?P<n>\d{{1,4}}(?: ?[a-h])?)(?!\w|[.,:]\d)")
_STREET_DE_AT = re.compile(r"(?<![\w-])(?P<s>(?:[Aa]m|[Aa]n der|[Aa]uf der|[Aa]uf dem|[Ii]m|[Zz]um|[Zz]ur|[Uu]nter den|[Hh]inter der) (?:[A-ZÄÖÜ][^\W\d_]+ ){0,1}[A-ZÄÖÜ][^\W\d_]+) (?P<n>\d{1,3}(?: ?[a-h])?)(?!\w|[.,:]\d)")
_STREET_ES = _rx(rf"(?<![\w-])(?P<s>(?:calle|c/|avenida|avda\.?|av\.|plaza|pza\.?|camino|paseo|ronda|travesía|carretera|cuesta|glorieta) ?(?:(?:de las|de los|de la|del|de|la|el|los|las) )?(?:{_WORD} ){{0,2}}?{_WORD}),? ?(?P<n>(?:n\.? ?[º°]\.? ?|núm\.? ?)?\d{{1,4}})(?!\w|[.,:]\d)")
_STREET_FR = re.compile(r"(?<![\w.:,/#@-])(?P<n>\d{1,4}(?: ?(?i:bis|ter|quater))?),? (?P<s>(?i:rue|avenue|boulevard|bd|place|impasse|chemin|quai|allée|cours|passage|route|sentier|square) (?i:(?:de la|de l['’]|du|des|de|d['’]|la|le|les) ?)?[A-ZÀ-Þ][^\W\d_]*(?:[-'’ ][A-ZÀ-Þ][^\W\d_]*){0,2})(?!\w)")
_STREET_FR_LOW = _rx(r"(?<![\w.:,/#@-])(?P<n>\d{1,4}(?: ?(?:bis|ter|quater))?),? (?P<s>(?:rue|avenue|boulevard|place|impasse|chemin|quai|allée|cours|passage|sentier) (?:(?:de la|de l['’]|du|des|de|d['’]) ?)[^\W\d_]+(?: [^\W\d_]+){0,2}?)(?=[,.;:\"'\n<)]|$| à | now| in )")
#: What of its words tells that a text may have a street of each pattern.
_EN_WORDS = frozenset(_EN_KINDS.split("|"))
_ES_WORDS = _words("calle avenida avda av plaza pza camino paseo ronda travesía carretera cuesta glorieta")
_FR_WORDS = _words("rue avenue boulevard bd place impasse chemin quai allée cours passage route sentier square")
_AT_WORDS = _words("am auf im zum zur unter hinter der")
_NUMBERED = re.compile(r"\.? \d")
_DE_TAILS = ("straße", "strasse", "weg", "gasse", "platz", "allee", "ufer", "damm", "ring", "steig", "steg", "pfad", "hof", "wall", "graben", "kamp", "brücke", "markt", "chaussee", "str")
_EN, _DE, _ES, _FR, _DE_AT, _IDS, _TITLE, _KNOWN, _PII_AT = (1 << n for n in range(9))


class Lexicon:
    """What each word tells of a text that has it, remembered: which searches are worth while."""

    def __init__(self, known: Known):
        self.known, self.memory = known, {}

    def _tell(self, word: str) -> int:
        w = word.lower()
        flags = (_EN if w in _EN_WORDS else 0) | (_DE if w.endswith(_DE_TAILS) else 0) | (_ES if w in _ES_WORDS else 0) | (_FR if w in _FR_WORDS else 0) | (_DE_AT if w in _AT_WORDS else 0)
        flags |= (_IDS if w in _ID_WORDS or any(x in w for x in _ID_STEMS) else 0) | (_TITLE if w in _TITLED or w in _CLOSINGS else 0) | (_PII_AT if w == "at" else 0)
        return flags | (_KNOWN if _one_case(word) and w in self.known.all else 0)

    def of(self, words: Iterable[str]) -> tuple[int, dict[int, list[str]]]:
        """The flags of a text's words, and the words of those flags whose places matter."""
        memory, flags, named = self.memory, 0, {}
        if len(memory) > 500_000:
            memory.clear()
        for w in words:
            f = memory.get(w)
            if f is None:
                f = memory[w] = self._tell(w)
            if f:
                flags |= f
                for one in (_KNOWN, _TITLE, _DE, _IDS):
                    if f & one:
                        named.setdefault(one, []).append(w)
        return flags, named


def _places(t: str, words: Iterable[str]) -> Iterator[tuple[str, int, int]]:
    """Where words stand in a text, as whole words."""
    for w in words:
        at = t.find(w)
        while at >= 0:
            end = at + len(w)
            if not (t[at - 1 : at].isalpha() or t[end : end + 1].isalpha()):
                yield w, at, end
            at = t.find(w, end)


#: Words that no street is named by.
_NO_STREET = _words("the before after and of in at to is was were for on me twice any no when that from with window day days")
_TOWN_AFTER = re.compile(r"(?:, ?[A-ZÀ-Þ]|\"|\n|\.|$|;| in [A-Z]|,? \(?[A-Z]\w+)")
_NOT_AFTER = _rx(r" (?:map|on|of|item)\b")


def _german(t: str, ends: list[str]) -> Iterator[re.Match]:
    """Streets whose last word is one of these, followed by a number."""
    seen = -1
    for _, at, end in sorted(_places(t, ends), key=lambda x: x[1]):
        if _NUMBERED.match(t, end) and at > seen:
            if (m := _STREET_DE.search(t, max(0, t.rfind("\n", 0, at) + 1, at - 32), end + 12)) and m.end() > end:
                seen = m.end()
                yield m


def _addresses(t: str, flags: int, ends: list[str]) -> Iterator[Candidate]:
    rxs = []
    if flags & _EN:
        rxs.append(_STREET_EN)
    if flags & _ES or "c/" in t or "C/" in t:
        rxs.append(_STREET_ES)
    if flags & _FR:
        rxs += [_STREET_FR, _STREET_FR_LOW]
    if flags & _DE_AT:
        rxs.append(_STREET_DE_AT)
    for rx in (*rxs, _STREET_DE) if ends else rxs:
        for m in _german(t, ends) if rx is _STREET_DE else rx.finditer(t):
            parts = m["s"].split()
            low = [w.lower() for w in parts]
            if rx is _STREET_EN and not _NO_STREET.isdisjoint(low):
                continue
            before, after = _before(t, m.start(), False), t[m.end() : m.end() + CONTEXT]
            home = before in _HOME or m.start() == 0 or t[m.start() - 1] == "\n" or t[max(0, m.start() - 2) : m.start()] == ", "
            votes = [
                _vote(len(parts) > 1 or rx is _STREET_DE, rx is _STREET_EN and not {"way", "street", "road", "main"}.isdisjoint(low[:-1])),
                _vote(home, before in _COUNTS and not before in _HOME),
                _vote(_TOWN_AFTER.match(after) is not None, _NOT_AFTER.match(after) is not None),
                _vote(m["s"][:1].isupper() or m["s"].islower(), False),
            ]
            yield Candidate(ADDRESS, m.start(), m.end(), "".join(votes), re.sub(r"\D", "", m["n"]), m["s"].lower())


# ---- names of people

_C = "[A-ZÀ-ÞŠŽŁ]"
_REST = rf"(?:['’]{_C})?{_L}+(?:-{_C}(?:['’]{_C})?{_L}+)*"
_CAP = rf"(?:{_C}{_REST})"
#: A capital at the start of a word.
_START = rf"{_C}(?<![\w@.\-'’]{_C})"
_PART = r"(?:de la |De La |DE LA |de las |de los |del |de |von der |(?<!wurde )von |van der |van den |van |VAN DER |VON DER |VAN |VON |DEL |der |di |da |du |zu |St\. |st\. |ST\. |Saint )"
_FAMILY = rf"(?:{_PART}?{_CAP})"
_FULL = re.compile(rf"(?P<g>{_START}{_REST})(?: (?P<i>[A-Z])\.)? (?P<f>{_FAMILY})(?![\w@]|-\w|\.\w)")
_INITIAL = re.compile(rf"(?P<g>{_START})\. (?:(?P<i>[A-Z])\. )?(?P<f>{_FAMILY})(?![\w@]|-\w|\.\w)")
_COMMA = re.compile(r", [A-ZÀ-ÞŠŽŁ]")
_TURNED_LEFT = re.compile(rf"(?<![\w@.\-'’])(?P<f>{_FAMILY})\Z")
_TURNED = re.compile(rf"(?<![\w@.\-'’])(?P<f>{_FAMILY}), (?P<g>{_CAP}|[A-Z](?=\.))(?P<dot>\.)?(?: (?P<i>[A-Z])\.)?(?![\w@]|-\w)")
_ANY = rf"{_L}{{2,}}(?:['’-]{_L}+)*"
_LOW_PART = r"(?:de la |von |van der |van |st\. |d['’]|o['’]|mc)"
_LOW_FULL = _rx(rf"(?<![\w@.\-'’])(?P<g>{_ANY}|[a-z]\.)(?: (?P<i>[a-z])\.)? (?P<f>{_LOW_PART}?{_ANY})(?![\w@]|-\w|\.\w)")
_LOW_TURNED = _rx(rf"(?<![\w@.\-'’])(?P<f>{_LOW_PART}?{_ANY}), (?P<g>{_ANY})(?: (?P<i>[a-z])\.)?(?![\w@]|-\w)")
_LOW_MAIL = _rx(_LOW_FULL.pattern + r" ?(?:[(<]| = ?) ?$")
#: Titles that stand before names in one case of which nothing else is known.
_TITLED = _words("mr mrs ms dr prof herr herrn frau señor señora sr sra doña monsieur madame mme")
#: A number before a title makes it a unit of time or length.
_UNIT = re.compile(r"\d ?\w+\W*\Z")
_GAP = re.compile(r"\.? |,?\s*\n")
_CLOSINGS = _words("regards sincerely cheers best thanks grüßen grüße gruß cordialement saludos saludo")
_PLACE_AFTER = re.compile(r",? ?(?:<|\(|= |\d{1,4}[A-Z]? \w|,? ?[\w.+-]+ ?(?:@|[\[(]at))|,? at \+?[(\d]|, (?:calle|avenida|plaza|camino|paseo|ronda)\b|, [^\W\d_]+ ?(?:straße|weg|gasse|platz|allee)\b|\"|\s*$|\s*\n")
#: Words that begin sentences or labels and are no given or family name.
_NO_NAME = _words(
    "account an and are as ask at audit bill but by can cc check compare contact dear debug for from he her his how if in info is it its los mobile my new no not of on or our please post regards reply route send she signed so still that the their there they this to try under user very warn was we what when where which who why with you your order trade nothing someone somebody everybody honestly frankly lives phone tax mail email holder office row item saint west north east south port long old job driver social national passport address kind best many one two three all each every after before during since while step see open market main page chapter section version",
    "bitte das der die den dem des ein eine einen einem einer kein keine kunde kundin laut mein meine sein seine ihr ihre unser im am zum zur zwischen wir ich er sie es etwas und oder aber nach vor von bei mit für seit warum heute gestern wohnhaft adresse reisepass ausweisnr steuer herr frau alter neu neue neuer kurze wo wenn dann",
    "el la las los un una y o de del en al es por para con según señor señora sra sr don doña pasaporte dni nie nif tel calle avenida plaza camino paseo ronda domicilio titular mi su nuestro hoy ayer cada este esta se no si",
    "le les un une et ou du des en au aux est par pour avec selon titulaire passeport cni mme mlle monsieur madame mon ma mes son sa notre ce cette chaque aujourd hier si il elle on nous vous",
    "mr mrs ms dr prof",
)


#: Common nouns, which follow words that are also given names (Will, Mark, Grace, Art) but are no family names.
_COMMON = _words(
    "spread price prices limit limits period periods tick ticks rule rules row rows order orders volume depth quote quotes trade trades fee fees funding premium book books level levels market markets grid bar bars feed batch signal drawdown",
    "value values size time date number rate rates data table file report group team service system process point line map fill cost share stock change error test account bank card cash check contract event index list model note offer office option page part plan power program project question record result risk room score section side source state step term title type unit use user version view week work year",
)


def _fold(s: str) -> str:
    return s.lower().replace("’", "'")


def _plain(s: str) -> str:
    """Letters only, for comparison with the local part of an address."""
    return re.sub(r"[^a-z]", "", _fold(s).translate(str.maketrans("áàâäãåçéèêëíìîïñóòôöõøúùûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")))


def _one_case(s: str) -> bool:
    return s == s.lower() or s == s.upper()


def _low_names(t: str, known: Known, names: list[str], titles: list[str], mails: list[tuple[int, str]]) -> Iterator[re.Match]:
    """Names in one case throughout, beside known names, titles and addresses."""
    for name, at, end in _places(t, names):
        if name.lower() in known.given and (m := _LOW_FULL.match(t, at)):
            yield m
        if name.lower() in known.endings:
            for rx in (_LOW_FULL, _LOW_TURNED):
                yield from (m for m in _overlapping(rx, t, max(0, at - 32), end + 20) if m.start("f") <= at < m.end("f"))
    for _, at, end in _places(t, titles):
        if not t[max(0, at - 2) : at].strip().isdigit() and (gap := _GAP.match(t, end)) and (m := _LOW_FULL.match(t, gap.end())):
            yield m
    for at, _ in mails:
        if m := _LOW_MAIL.search(t, max(0, at - 60), at):
            yield m


def _turned(t: str) -> Iterator[re.Match]:
    for c in _COMMA.finditer(t):
        left = _TURNED_LEFT.search(t, max(0, c.start() - 40), c.start())
        if left and (m := _TURNED.match(t, left.start())):
            yield m


def _names(t: str, known: Known, names: list[str], titles: list[str], mails: list[tuple[int, str]], taken: list[tuple[int, int]]) -> Iterator[Candidate]:
    """taken: spans that are addresses, if anything."""
    seen: set[tuple[int, int]] = set()
    found = [(m, False) for rx in (_FULL, _INITIAL) for m in _overlapping(rx, t)] + [(m, False) for m in _turned(t)]
    found += [(m, True) for m in _low_names(t, known, names, titles, mails)]
    for m, loose in found:
        g, f = _fold(m["g"]).rstrip("."), _fold(m["f"])
        if len(g) > 1 and (g in _NO_NAME or g in _ID_WORDS or _ID_NEAR.match(g)) or f in _NO_NAME:
            continue
        turned = m.re in (_TURNED, _LOW_TURNED)
        start, end = min(m.start("g"), m.start("f")), max(m.end("f"), m.end("i") if turned else 0, m.end("g"))
        if m.re is _TURNED and len(m["g"]) > 1 and m["dot"]:
            end = m.end("g")  # the full stop ends a sentence
        elif m.re is _TURNED and (m["i"] or m["dot"]):
            end = m.end()
        whole = t[start:end]
        if (start, end) in seen or loose and not _one_case(whole):
            continue
        # Both parts are in capitals, or neither is.
        if not loose and len(m["g"]) > 2 and m["g"].isupper() != m["f"].split(" ")[-1].isupper():
            continue
        if any(start < b and a < end for a, b in taken) or any(a <= start and end <= b for a, b in seen):
            continue
        kg = any(p in known.given for p in g.split("-"))
        kf = f in known.family or any(p in known.family for p in f.split("-")) or f.split(" ")[-1] in known.family
        before = _before(t, start)
        line = t[max(0, start - 3) : start].rstrip(" \t")
        at_start = start == 0 or line.endswith("\n")
        firm = before in _TITLES and not _UNIT.search(t, max(0, start - 12), start) or before in _PERSON and (not at_start or before in _CLOSINGS) or line.endswith("--")
        told = firm or before in _MAYBE_PERSON and not at_start
        soft = told or at_start
        # A capitalised word just before belongs to the same title or term, unless it is one of those.
        term = not soft and t[start - 1] == " " and t[start - 1 - len(before) : start - 1].istitle() and before != ""
        does, beside = _after(t, end) in _DOES, _PLACE_AFTER.match(t, end) is not None
        then = does or beside
        town = any(0 <= start - b <= 8 for _, b in taken)
        tail = _plain(f)
        mail = any(abs(at - end) < 160 and len(tail) > 2 and (tail in x or (len(g) > 2 and _plain(g) in x)) for at, x in mails)
        if loose and not (kf and (kg or len(g) == 1 or soft or then) or kg and (firm or then) or firm and before in _TITLES or mail):
            continue
        if turned and not (kg or kf or soft or then):
            continue  # two words with a comma between, as any text has
        if town and not (kg or kf or firm):
            continue  # the town of an address, and what begins after it
        votes = [_vote(kg or len(g) == 1 and kf), _vote(kf, f in _COMMON and not kf), _vote(firm), _vote(told, term), _vote(does), _vote(beside, town), _vote(mail)]
        seen.add((start, end))
        yield Candidate(NAME, start, end, "".join(votes), g, f)


def _overlapping(rx: re.Pattern, t: str, start: int = 0, end: int = 2**31) -> Iterator[re.Match]:
    """All matches, also those that begin within another."""
    m = rx.search(t, start, end)
    while m:
        yield m
        step = t.find(" ", m.start(), m.end())
        m = rx.search(t, step + 1 if step >= 0 else m.end(), end)


def candidates(t: str, lexicon: Lexicon, words: Iterable[str] | None = None) -> Iterator[Candidate]:
    """``words``: the different ones of the text, by ``WORD``, if they are at hand."""
    t = t.replace("\u00a0", " ")
    flags, named = lexicon.of(set(WORD.findall(t)) if words is None else words)
    mails = []
    if "@" in t or flags & _PII_AT:
        for c in _emails(t):
            mails.append((c.start, _plain(_AT.split(t[c.start : c.end])[0])))
            yield c
    starts = [m.start() for m in _DIALLED.finditer(t)]
    yield from _phones(t, starts)
    yield from _ids(t, starts, named.get(_IDS, []))
    homes = []
    for c in _addresses(t, flags, named.get(_DE, [])):
        if c.votes[0] == "+":
            homes.append((c.start, c.end))
        yield c
    yield from _names(t, lexicon.known, named.get(_KNOWN, []), named.get(_TITLE, []), mails, homes)
