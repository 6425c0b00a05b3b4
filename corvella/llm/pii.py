"""Personal data in free text and JSON: detection, and keyed surrogates (problem 2)."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvella.session import staged

KINDS = ("email", "phone", "id_number", "address", "name")

# --- Fixed values: forms of addresses, numbers and labels in English, German, French and Spanish ---
_AT = r"(?:\s?@\s?|\s?[(\[{]\s?(?:at|arroba)\s?[)\]}]\s?|\s(?:AT|at|arroba)\s)"
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|punkt|point|punto)\s?[)\]}]\s?|\s(?:DOT|dot|punto)\s)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL = re.compile(
    rf"(?<![\w.+@/-])[A-Za-z0-9À-ÿ](?:[\w.+%-]*[\w+])?(?:\s?@\s?{_LABEL}(?:{_DOT}{_LABEL})*?{_DOT}[A-Za-z]{{2,}}"
    rf"(?:\.[A-Za-z]{{2,}})*|{_AT}{_LABEL}(?:{_DOT}{_LABEL})*?{_DOT}[A-Za-z]{{2,}}(?:{_DOT}[A-Za-z]{{2,}})*)(?![\w@])"
)
_EMAIL_HINT = re.compile(r"@|[(\[{]\s?(?:at|arroba)\s?[)\]}]|\s(?:AT|at|arroba)\s\S+?(?:\.|\s(?:DOT|dot|punto)\s|\s?[(\[]dot)")
PHONE = re.compile(
    r"(?<![\w.+/-])(?<!\d )(?:"
    r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?:\s?(?:ext\.?|x)\s?\d{1,5})?"
    r"|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?:\s?(?:ext\.?|x)\s?\d{1,5})?"
    r"|\d{3}([ .-])\d{3}\1\d{4}(?:\s?(?:ext\.?|x)\s?\d{1,5})?"
    r"|(?:\+|00)44[ .-]?(?:\(0\))?[ .-]?\d{2,5}[ .-]?\d{3,4}[ .-]?\d{3,4}"
    r"|(?:\+|00)(?:33|34|49|39|41|43|31|32)(?:[ ./-]?\(0\))?(?:[ ./-]?\(?\d{1,11}\)?)(?:[ ./-]?\d{2,8}){0,6}(?!\d)"
    r"|\((?:\+|00)\d{1,3}\)(?:[ ./-]?\d{1,9}){2,6}"
    r"|\+\d{1,3}(?:[ ./-]?\(?\d{1,9}\)?){2,6}"
    r"|020[ ]?\d{4}[ ]?\d{4}|0[12378]\d{2,3}[ ]\d{3}[ ]?\d{3,4}"
    r"|0[1-9](?:([ .-]?)\d{2})(?:\2\d{2}){3}"
    r"|\(0\d{1,4}\)[ ./-]?\d{3,9}(?:[ -]\d{1,6})?|(?!0\d{2} \d{3} \d{3}(?!\d))0\d{2,4}[ /-]\d{3,8}(?:[ -]\d{1,5}){0,2}"
    r"|[5-9]\d{2}(?: \d{2}){3}"
    r")(?![\w]|[.-]\d)"
)
_ID_LABEL = (
    r"social security (?:number|no\.?)|SSN|national insurance (?:number|no\.?)|NI (?:number|no\.?)|tax ID|TIN|health insurance (?:number|no\.?)|NHS (?:number|no\.?)"
    r"|passport(?:\s?(?:no\.?|number))?|driver['’]s licen[cs]e(?: (?:no\.?|number))?|driving licen[cs]e(?: (?:no\.?|number))?"
    r"|Sozialversicherungsnummer|Versichertennummer|Krankenversicherungsnummer|Ausweisnummer|Personalausweis(?:-?Nr\.?|nummer)?|Reisepass(?:-?Nr\.?|nummer)?"
    r"|Passnummer|Führerschein(?:-?Nr\.?|nummer)?|Steuer-?ID(?:-?Nr\.?)?|Steuernummer|Identifikationsnummer"
    r"|numéro de sécurité sociale|n[°º]? de sécurité sociale|NIR|carte d['’]identité|passeport|permis de conduire|numéro fiscal"
    r"|DNI|NIE|NIF|pasaporte|n\.?º de afiliación|número de (?:la )?seguridad social|permiso de conducir"
)
ID_NUMBER = re.compile(
    rf"(?<!\w)(?i:{_ID_LABEL})(?i:\s*(?:[:=#]|is|ist|est|es|no\.?|Nr\.?|n[°º]\.?|\.)){{0,2}}\s*"
    r"(?P<id>(?=[A-Za-z0-9.\-/ ]*\d)[A-Z0-9](?:[A-Z0-9]|[ .\-/](?=[A-Z0-9]*\d)|[ .\-](?=[A-Z](?![A-Za-z])))*)"
)
_ID_BARE = re.compile(
    r"(?<![\w.+/-])(?P<id>(?:QQ|(?!BG|GB|KN|NK|NT|TN|ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]) ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{6}\d{2}[A-EHLMPRST]\d{2}[A-Z]\d{3}[A-Z]|[12] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|[12]\d{12} \d{2}|\d{2}\.\d{3}\.\d{3}-[A-Z]|[XYZ]\d{7}[A-Z]|\d{2} \d{6} [A-Z] \d{3})(?!\w)"
)
_STREET_EN = r"(?:St(?:reet)?|Ave(?:nue)?|Blvd|Boulevard|Road|Rd|Lane|Ln|Close|Drive|Court|Place|Square|Terrace|Way|Crescent|Gardens)"
_UP = r"[A-ZÀ-ÖØ-ÞΑ-ΫА-ЯЁ]"
_W = r"[\wÀ-ÿ'’-]+"
ADDRESS = re.compile(
    "(?<![\\w-])(?:"
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit|FLAT|APT\.?) \d{{1,4}}[A-Za-z]?, )?\d{{1,5}}[A-Za-z]? {_UP}{_W}(?: {_UP}{_W}){{0,2}}? (?i:{_STREET_EN})(?![\w])\.?"
    rf"|{_UP}{_W}(?:straße|strasse|str\.|weg|gasse|allee|platz|ufer|damm|ring|STRASSE|STRAßE|STR\.|WEG|GASSE|ALLEE|PLATZ) \d{{1,4}} ?[a-z]?(?![\w])"
    rf"|(?:Am|An der|An den|Im|In der|Zum|Zur|Auf der|Unter den|AM|AN DER|IM|IN DER|ZUM|ZUR) {_UP}{_W} \d{{1,4}} ?[a-z]?, (?=(?:D-)?\d{{5}})"
    r"|\d{1,4}(?:(?: (?:bis|ter|BIS|TER))|[A-Da-d])?,? (?i:rue|avenue|av\.|boulevard|bd|place|chemin|impasse|allée|quai|route|cours|square|passage) (?i:de la |de l['’]|des |du |de |d['’])?"
    rf"{_UP}{_W}(?: (?:(?:de|du|des|la|le|aux)\s)?{_UP}{_W}){{0,3}}"
    r"|(?i:C/|Calle|Avda\.?|Avenida|Plaza|Pza\.?|Paseo|Camino|Ronda|Travesía) (?i:de la |de los |de las |del |de )?"
    rf"{_UP}{_W}(?: {_UP}{_W}){{0,3}},? (?:n\.?º ?|N\.?º ?|núm\. ?)?\d{{1,4}}(?:, ?\d{{1,2}}\.?º ?[A-Za-z]?)?"
    ")"
)
_TITLE = r"(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herrn?|Frau|Mme|Mlle|M|Sra|Sr|Srta|Dra|Don|Doña|Г-н|Г-жа|г-н|г-жа|Д-р|д-р|Κος|Κα|κος|κα)\.?\s)"
_PART = rf"{_UP}(?:['’]{_UP})?[\wÀ-ÿ]*(?:-{_UP}[\wÀ-ÿ]*)*"
_LINK = r"(?:(?:van der|van den|van|von der|von|zu|de la|de los|del|de|du|des|di|da|dos|Le|La|VAN DER|VON|DE LA|DEL|DE|DU|LE|LA) )?"
_FULL = rf"{_PART} (?:{_PART}\.? )?(?:{_PART}\. )?{_LINK}{_PART}"
_TURNED = rf"{_LINK}{_PART}, {_PART}(?: {_PART}\.)?(?![\w])"
_CUE = (
    r"(?:Patient(?:in|e)?|Paciente|Witness|Signed by|regards|Next of kin is|According to|Contact|apologies|Minutes|Présents|Asistentes|Protokoll|entschuldigt|excusés|Gezeichnet"
    r"|Reviewed with|no longer valid for|The file of|Rücksprache mit|Vu avec|Revisado con|Avisar al|Joindre le|Firmado por|Signé par|Unterschrift)"
)
CUED_NAME = re.compile(rf"(?<!\w)(?:{_CUE}\s?:? {_TITLE}?|{_TITLE})(?P<name>{_TURNED}|{_FULL})")
#: Keys of the metadata whose value is a person.
_OWNED = re.compile(rf'"(?:owner|author|uploaded_by)"\s*:\s*"(?P<name>{_TURNED}|{_FULL})')
_LINKS = {"van", "der", "den", "von", "zu", "de", "la", "los", "del", "du", "des", "di", "da", "dos", "le"}
_WORD = re.compile(r"[^\W\d_][\w'’]*(?:-[^\W\d_][\w'’]*)*")
_INITIAL = re.compile(r"\s[A-ZÀ-Þ]\.")
_MALE, _FEMALE = {"mr", "herr", "herrn", "m", "sr", "don", "г-н", "κος"}, {"mrs", "ms", "miss", "frau", "mme", "mlle", "sra", "srta", "dra", "doña", "г-жа", "κα"}

_ESCAPE = re.compile(r'\\(?:u[0-9a-fA-F]{4}|.)', re.S)
_SIMPLE = {"n": "\n", "t": " ", "r": "\n", "b": " ", "f": " "}
#: Soft hyphen, zero-width characters and byte-order mark.
_INVISIBLE = "\u00ad\u200b\u200c\u200d\ufeff"
_BLANK = " \t\u00a0\u2009\u202f"
_ODD = re.compile(rf"[{_INVISIBLE}]|[{_BLANK}]{{2,}}|[{_BLANK[1:]}]|\r\n?")


def _mapped(raw: str, pattern: re.Pattern, change) -> tuple[str, list[int] | None]:
    """The text with every match changed, and the place in ``raw`` of each of its characters."""
    out, where, last = [], [], 0
    for m in pattern.finditer(raw):
        out.append(raw[last : m.start()])
        where.extend(range(last, m.start()))
        new = change(m.group())
        out.append(new)
        where.extend([m.start()] * len(new))
        last = m.end()
    if not where and not last:
        return raw, None
    out.append(raw[last:])
    where.extend(range(last, len(raw) + 1))
    return "".join(out), where


def _unescape(e: str) -> str:
    return chr(int(e[2:], 16)) if e[1] == "u" and len(e) == 6 else _SIMPLE.get(e[1], e[1])


def _smooth(e: str) -> str:
    return "\n" if e[0] == "\r" else "" if e[0] in _INVISIBLE else " "


def readable(raw: str, is_json: bool) -> tuple[str, list[int] | None]:
    """Text as a reader sees it: escapes of JSON resolved, runs of blanks made one, invisible characters gone."""
    text, where = _mapped(raw, _ESCAPE, _unescape) if is_json and "\\" in raw else (raw, None)
    smooth, at = _mapped(text, _ODD, _smooth)
    if at is None or where is None:
        return smooth, at if where is None else where
    return smooth, [where[i] if i < len(where) else len(raw) for i in at]


def cued_names(text: str, is_json: bool = False) -> list[tuple[int, int]]:
    """Spans of names that follow a title or a word that announces one."""
    out = [m.span("name") for m in CUED_NAME.finditer(text)]
    return out + [m.span("name") for m in _OWNED.finditer(text)] if is_json else out


def name_parts(name: str) -> tuple[list[str], str]:
    """Given names and the family name, folded; links such as ``van der`` are left out."""
    if "," in name:
        family, given = name.split(",", 1)
    else:
        words = name.split()
        given, family = words[0], words[-1]
    fold = lambda w: w.casefold().strip(" .")
    family = [w for w in family.split() if fold(w) not in _LINKS] or [family]
    first = (given.split() or [given])[0]
    return [fold(p) for p in first.split("-") if p], fold(family[-1])


_NO_PAIRS = np.empty(0, np.int64)


def _announced(given: str, family: str, pairs: np.ndarray) -> bool:
    """Whether one of the given names and the family name are among the hashes of announced pairs."""
    for g in given.split("-"):
        h = xxhash.xxh64_intdigest(f"{g} {family}".encode("utf-8", "surrogatepass"), seed=42)
        h = np.int64(h - 2**64 if h >= 2**63 else h)
        k = pairs.searchsorted(h)
        if k < len(pairs) and pairs[k] == h:
            return True
    return False


def known_names(text: str, given: frozenset, family: frozenset, pairs: np.ndarray = _NO_PAIRS) -> list[tuple[int, int]]:
    """Spans of ``Given [I.] [link] Family`` and ``[link] Family, Given [I.]`` whose words are in the lists, or announced together."""
    out: list[tuple[int, int]] = []
    words = []
    for m in _WORD.finditer(text):
        w = m.group()
        if w[0].isupper() or w in _LINKS:
            f = w.casefold()
            words.append((m.start(), m.end(), f, f in given or ("-" in f and all(p in given for p in f.split("-"))), f in family))
    n = len(words)
    i = 0
    while i < n:
        a, z, f, is_given, is_family = words[i]
        if is_given or len(pairs):
            at, j = z, i + 1
            m = _INITIAL.match(text, at)
            if m:
                at = m.end()
                while j < n and words[j][0] < at:
                    j += 1
            elif is_given and j < n and words[j][3] and not words[j][4] and words[j][0] == at + 1 and text[at].isspace():
                at, j = words[j][1], j + 1
            while j < n and words[j][2] in _LINKS and words[j][0] == at + 1 and text[at].isspace():
                at, j = words[j][1], j + 1
            if j < n and words[j][0] == at + 1 and text[at].isspace() and ((is_given and words[j][4]) or (len(pairs) and f not in _LINKS and _announced(f, words[j][2], pairs))):
                out.append((a, words[j][1]))
                i = j + 1
                continue
        if i + 1 < n and text[z : words[i + 1][0]] in (", ", ",\n") and ((is_family and words[i + 1][3]) or (len(pairs) and _announced(words[i + 1][2], f, pairs))):
            k, begin = i, a
            while k > 0 and words[k - 1][2] in _LINKS and words[k - 1][1] + 1 == begin:
                k, begin = k - 1, words[k - 1][0]
            end = words[i + 1][1]
            m = _INITIAL.match(text, end)
            out.append((begin, m.end() if m else end))
            i += 2
            continue
        i += 1
    return out


def find_items(text: str, given: frozenset = frozenset(), family: frozenset = frozenset(), is_json: bool = False, pairs: np.ndarray = _NO_PAIRS) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the items in a readable text, without overlaps."""
    spans: list[tuple[str, int, int]] = []
    taken = bytearray(len(text))

    def claim(kind: str, a: int, z: int) -> None:
        if not any(taken[a:z]):
            taken[a:z] = b"\1" * (z - a)
            spans.append((kind, a, z))

    if _EMAIL_HINT.search(text):
        for m in EMAIL.finditer(text):
            claim("email", *m.span())
    if _DIGITS.search(text):
        for pattern in (ID_NUMBER, _ID_BARE):
            for m in pattern.finditer(text):
                v = m.group("id")
                if sum(c.isalnum() for c in v) >= 6 and sum(c.isdigit() for c in v) >= 4:
                    claim("id_number", *m.span("id"))
        for m in ADDRESS.finditer(text):
            claim("address", *m.span())
        for m in PHONE.finditer(text):
            if sum(c.isdigit() for c in m.group()) >= 8:
                claim("phone", *m.span())
    for a, z in known_names(text, given, family, pairs):
        claim("name", a, z)
    for a, z in cued_names(text, is_json):
        claim("name", a, z)
    return sorted(spans, key=lambda s: s[1])


_DIGITS = re.compile(r"\d")


def canonical(kind: str, value: str) -> str:
    """The same for all mentions of an item: how it is written, its case and the order of a name do not matter."""
    if kind == "email":
        v = re.sub(r"\s?[(\[{]\s?(?:at|arroba)\s?[)\]}]\s?|\s(?:AT|at|arroba)\s|\s?@\s?", "@", value)
        return re.sub(r"\s?[(\[{]\s?(?:dot|punkt|point|punto)\s?[)\]}]\s?|\s(?:DOT|dot|punto)\s", ".", v).lower()
    if kind in ("phone", "id_number"):
        return "".join(c for c in value.upper() if c.isalnum())
    if kind == "name":
        given, family = name_parts(value)
        return " ".join([*given, family])
    return " ".join(value.casefold().split())


def learn_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", metadata_col: str | None = "metadata_json") -> tuple[frozenset, frozenset, np.ndarray]:
    """Given and family names that stand in announced names of all documents with two partners or more, and all announced pairs.

    The pairs are sorted 64-bit hashes, 8 bytes each.  The lists and the hashes grow with the different names of the documents.
    """

    def run(batches):
        for b in batches:
            rows = []
            for c in range(b.num_columns):
                for raw in b.column(c).to_pylist():
                    if raw:
                        text, _ = readable(raw, c == 1)
                        for a, z in cued_names(text, c == 1):
                            given, family = name_parts(text[a:z])
                            rows += [("given", g, family) for g in given] + [("family", family, g) for g in given[:1]]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in cols], names=["part", "word", "partner"])

    cols = [docs[text_col]] + ([docs[metadata_col]] if metadata_col else [])
    seen = docs.select(*cols).mapInArrow(run, "part string, word string, partner string").groupBy("part", "word", "partner").agg(F.count(F.lit(1)).alias("n"))
    seen = staged(seen, "announced")
    pairs = seen.where("part = 'given' and length(word) > 1 and length(partner) > 1")
    words = staged(seen.groupBy("part", "word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("partners")), "names")
    kept = words.where((F.col("partners") >= 2) & (F.length("word") > 1)).collect()
    together = pairs.select(F.xxhash64(F.concat_ws(" ", "word", "partner")).alias("h")).distinct().toArrow().column("h").to_numpy()
    return *(frozenset(r.word for r in kept if r.part == p) for p in ("given", "family")), np.sort(together)


def personal_items(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", metadata_col: str | None = "metadata_json", names: tuple | None = None) -> DataFrame:
    """``(doc_id, field, kind, start_pos, end_pos, item, gender)``: every item of personal data in both fields.

    Positions are in characters of the field as stored, ``item`` is its canonical form and ``gender`` ``m``, ``f`` or empty by a
    title before it.  Names are those announced by a title or cue, and all pairs of the given and family names that ``learn_names``
    finds in the collection, and all other mentions of an announced given and family name together.  Null and empty fields have no items; broken JSON is read as far as it goes; repeated rows give
    their items again.
    """
    lists = docs.sparkSession.sparkContext.broadcast(names if names is not None else learn_names(docs, id_col, text_col, metadata_col))
    fields = [text_col] + ([metadata_col] if metadata_col else [])

    def run(batches):
        given, family, *more = lists.value
        pairs = more[0] if more else _NO_PAIRS
        for b in batches:
            keys = b.column(0).to_pylist()
            rows = []
            for c, field in enumerate(fields):
                for key, raw in zip(keys, b.column(c + 1).to_pylist()):
                    if not raw or key is None:
                        continue
                    text, where = readable(raw, c == 1)
                    for kind, a, z in find_items(text, given, family, c == 1, pairs):
                        gender = ""
                        if kind == "name":
                            before = text[max(0, a - 8) : a].split()
                            title = before[-1].strip(".").lower() if before else ""
                            gender = "m" if title in _MALE else "f" if title in _FEMALE else ""
                        start, end = (a, z) if where is None else (where[a], where[z] if z < len(where) else len(raw))
                        rows.append((key, field, kind, start, end, canonical(kind, text[a:z]), gender))
            cols = list(zip(*rows)) or [()] * 7
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names=["doc_id", "field", "kind", "start_pos", "end_pos", "item", "gender"])

    return docs.select(docs[id_col].cast("long"), *[docs[f] for f in fields]).mapInArrow(
        run, "doc_id bigint, field string, kind string, start_pos bigint, end_pos bigint, item string, gender string"
    )


# --- Fixed values: given names for surrogates by script and gender, and syllables of invented family names and streets ---
_GIVEN = {
    "LATIN": {
        "m": ["Alvin", "Bertil", "Cornel", "Dorian", "Emeric", "Falko", "Gregor", "Hamo", "Ivo", "Jorn", "Kasimir", "Ludo", "Marek", "Nils", "Oskar", "Pavel"],
        "f": ["Alba", "Benita", "Corinna", "Daria", "Elvira", "Fiona", "Greta", "Halina", "Ines", "Jolanda", "Katja", "Livia", "Marika", "Nadja", "Olga", "Paula"],
        "": ["Alex", "Bente", "Chris", "Dana", "Eli", "Florin", "Gale", "Hali", "Inge", "Jona", "Kim", "Luca", "Mika", "Noa", "Oli", "Pat"],
    },
    "CYRILLIC": {
        "m": ["Артём", "Богдан", "Виктор", "Герман", "Дамир", "Егор", "Захар", "Игнат"],
        "f": ["Алина", "Белла", "Вера", "Галина", "Дарья", "Ева", "Зоя", "Инна"],
        "": ["Саша", "Женя", "Валя", "Слава", "Шура", "Тоша", "Ника", "Паша"],
    },
    "GREEK": {
        "m": ["Άρης", "Βίκτωρ", "Γιάννης", "Δήμος", "Ηλίας", "Θάνος", "Λάμπρος", "Μάνος"],
        "f": ["Άννα", "Βάσω", "Γιούλα", "Δάφνη", "Ειρήνη", "Ζωή", "Θάλεια", "Λένα"],
        "": ["Άλκη", "Εύα", "Ίρι", "Κρις", "Λου", "Μαξ", "Νίκι", "Ρένι"],
    },
}
_SYLLABLES = {
    "LATIN": ["ba", "den", "fol", "gar", "hil", "jor", "kan", "lem", "mor", "nel", "pas", "quin", "rov", "sel", "tor", "vas"],
    "CYRILLIC": ["ба", "ден", "фол", "гар", "хил", "йор", "кан", "лем", "мор", "нел", "пас", "кин", "ров", "сел", "тор", "вас"],
    "GREEK": ["βα", "δεν", "φολ", "γαρ", "χιλ", "ιορ", "καν", "λεμ", "μορ", "νελ", "πας", "κιν", "ροβ", "σελ", "τορ", "βας"],
}


def script(text: str) -> str:
    """The script of the first letter, as its Unicode name begins: ``LATIN``, ``CYRILLIC``, ``GREEK``, ``HEBREW`` and so on."""
    c = next((c for c in text if c.isalpha()), "a")
    return unicodedata.name(c, "LATIN").split()[0]


class _Stream:
    """Bytes that only the key, the item and the attempt determine."""

    def __init__(self, key: bytes, *about: str):
        self.key, self.about, self.n, self.rest = key, "\0".join(about).encode(), 0, b""

    def below(self, m: int) -> int:
        if len(self.rest) < 4:
            self.rest += hmac.new(self.key, self.about + b"\0%d" % self.n, hashlib.sha256).digest()
            self.n += 1
        v, self.rest = int.from_bytes(self.rest[:4], "big"), self.rest[4:]
        return v % m


def _word(r: _Stream, like: str, syllables: int) -> str:
    """An invented word in the script of ``like``; of scripts without syllables above, letters from the same block of the alphabet."""
    kind = script(like)
    if kind in _SYLLABLES:
        new = "".join(_SYLLABLES[kind][r.below(16)] for _ in range(syllables))
        return new if new != like else new + _SYLLABLES[kind][r.below(16)]
    out = []
    for c in like + like[:1] * max(0, syllables - len(like)):
        block = [d for d in map(chr, range(ord(c) & ~127, (ord(c) & ~127) + 128)) if d.isalpha() and d != c and d.isupper() == c.isupper()]
        out.append(block[r.below(len(block))] if c.isalpha() and block else c)
    return "".join(out)


def _mailbox(local: str, owner: str) -> str:
    """The owner's stand-in in the form of the mailbox: initial or whole given name, the same separator, family name first or last."""
    given, family = (w.replace("-", "") for w in owner.lower().split(" ", 1))
    parts = re.split(r"[._-]", local)
    sep = next((c for c in local if c in "._-"), "")
    if len(parts) < 2:
        return (given[0] if len(local) < len(family) + 3 else given) + family
    if len(parts[-1]) == 1 < len(parts[0]):
        return f"{family}{sep}{given[0]}"
    return f"{given[0] if len(parts[0]) == 1 else given}{sep}{family}"


def surrogate(kind: str, item: str, hint: str, attempt: int, key: bytes) -> str:
    """A stand-in of the same kind and format: digits for digits, letters for letters, a name for a name of the same script.

    ``hint`` is the gender of a name, and of an e-mail address the stand-in of its owner's name, or empty.
    """
    r = _Stream(key, kind, item, str(attempt))
    if kind == "name":
        *first, last = item.split(" ")
        writing = script(item)
        if writing in _GIVEN:
            pool = [g for g in _GIVEN[writing][hint] if g.casefold() not in first]
            given = "-".join(pool[r.below(len(pool))] for _ in first or [""])
        else:
            given = "-".join(_word(r, w, 2) for w in first or [last])
        return given + " " + _word(r, last, 3 + attempt).capitalize()
    if kind == "email":
        local = _mailbox(item.split("@")[0], hint) if hint else "".join(_SYLLABLES["LATIN"][r.below(16)] for _ in range(4 + attempt))
        return f"{local}{r.below(10**min(9, attempt)) + 1 if hint and attempt else ''}@example.{('com', 'net', 'org')[r.below(3)]}"
    out = []
    for i, c in enumerate(item):
        if c.isdigit():
            # a phone number's leading zeros are its form
            out.append(c if kind == "phone" and not item[: i + 1].strip("0") else str((int(c) + 1 + r.below(9)) % 10) if c.isdecimal() and (kind == "address" or i < 2) else str(r.below(10)))
        elif c.isalpha() and kind == "id_number":
            out.append(chr(65 + r.below(26)))
        else:
            out.append(c)
    if kind != "address":
        return "".join(out)

    def fresh(m: re.Match) -> str:
        word = m.group()
        if word in _STREET_WORDS:
            return word
        kept = next((e for e in _STREET_ENDS if word.endswith(e) and len(word) > len(e) + 1), "")
        return _word(r, word, 2) + kept if len(word) > 1 else chr(97 + (ord(word) + r.below(25)) % 26) if word.isascii() else _word(r, word, 1)

    words = [_LETTERS.sub(fresh, w) for w in "".join(out).split(" ")]
    return " ".join(w if w in _STREET_LINKS else w.title() for w in words)


_LETTERS = re.compile(r"[^\W\d_]+")
_STREET_LINKS = {"de", "del", "la", "las", "los", "el", "du", "des", "le", "les", "d", "l", "der", "die", "dem", "den", "am", "an", "im", "in", "zum", "zur", "auf", "of", "the"}
#: Kept in stand-ins of addresses: kinds of streets, parts of a house, and links; and the ends that tell the kind of a street.
_STREET_WORDS = _STREET_LINKS | {
    *("street", "st", "close", "avenue", "ave", "road", "rd", "lane", "ln", "drive", "dr", "court", "ct", "place", "pl", "square", "way", "terrace", "boulevard", "blvd", "bd", "flat", "apt", "apartment", "suite", "unit", "floor"),
    *("straße", "strasse", "str", "weg", "platz", "gasse", "allee", "ring", "ufer", "damm", "haus", "rue", "av", "chemin", "impasse", "allée", "quai", "bis", "ter", "bât", "appt", "étage"),
    *("calle", "c", "avenida", "avda", "paseo", "plaza", "pza", "camino", "carretera", "piso", "n", "nº", "º", "ª"),
}
_STREET_ENDS = ("straße", "strasse", "str", "weg", "gasse", "allee", "platz", "ufer", "damm", "ring")


def hinted(items: DataFrame) -> DataFrame:
    """``(kind, item, hint)`` of the names: the gender most often read before the name, else the one most often read before its given name."""
    names = items.where("kind = 'name'").select("item", "gender", F.substring_index("item", " ", 1).alias("given"))
    most = F.max_by("gender", F.struct("n", "gender"))
    by_given = names.where("gender != ''").groupBy("given", "gender").agg(F.count(F.lit(1)).alias("n")).groupBy("given").agg(most.alias("usual"))
    own = names.groupBy("item", "given", "gender").agg(F.count(F.lit(1)).alias("n")).groupBy("item", "given").agg(F.max_by("gender", F.struct(F.col("gender") != "", "n", "gender")).alias("gender"))
    return own.join(by_given, "given", "left").select(F.lit("name").alias("kind"), "item", F.when(F.col("gender") != "", F.col("gender")).otherwise(F.coalesce("usual", F.lit(""))).alias("hint"))


def owners(items: DataFrame, stand_ins: DataFrame) -> DataFrame:
    """``(item, hint)``: of the e-mail addresses whose mailbox holds a family name of the same document, the stand-in of that name."""
    plain = lambda c: F.regexp_replace(F.translate(F.lower(c), "äöüßáàâéèêëíìîïóòôúùûñç", "aousaaaeeeeiiiiooouuunc"), "[^a-z]+", "")
    mail = items.where("kind = 'email'").select("doc_id", "item", F.explode(F.split(F.substring_index("item", "@", 1), "[^\\p{L}]+")).alias("part")).where("length(part) > 2")
    # a mailbox without separators holds the family name behind an initial
    mail = mail.select("doc_id", "item", F.explode(F.array(plain(F.col("part")), plain(F.expr("substring(part, 2)")))).alias("part"))
    names = items.where("kind = 'name'").select("doc_id", F.col("item").alias("name"), plain(F.substring_index("item", " ", -1)).alias("part")).where("length(part) > 2").distinct()
    # of several of the family, the one whose given name begins as the mailbox does
    other = plain(F.substring("item", 1, 1)) != plain(F.substring("name", 1, 1))
    owned = mail.join(names, ["doc_id", "part"]).groupBy("item").agg(F.min_by("name", F.struct(other, "name")).alias("name"))
    return owned.join(stand_ins.where("kind = 'name'").select(F.col("item").alias("name"), F.col("stand_in").alias("hint")), "name").select("item", "hint")


def surrogates(items: DataFrame, key: bytes, rounds: int = 12) -> DataFrame:
    """``(kind, item, stand_in)`` of ``(doc_id, kind, item, gender)``: one stand-in an item, the same for all its mentions, no two of a kind alike and none an item itself.

    Names come first, with the gender of ``hinted``; then all else, where an e-mail address follows the stand-in of its owner.
    """
    if "doc_id" not in items.columns:
        items = items.withColumn("doc_id", F.lit(0))
    names = _drawn(hinted(items), items, key, rounds)
    rest = items.where("kind != 'name'").select("kind", "item").distinct().join(owners(items, names).withColumn("kind", F.lit("email")), ["kind", "item"], "left")
    return names.unionByName(_drawn(rest.select("kind", "item", F.coalesce("hint", F.lit("")).alias("hint")), items, key, rounds))


def _drawn(hinted_items: DataFrame, items: DataFrame, key: bytes, rounds: int) -> DataFrame:
    """Stand-ins that collide are drawn again with the next attempt, all but the one of the least item, and so are those that are
    an item of that kind, until none do.
    """

    def draw(batches):
        for b in batches:
            kinds, names, genders, tries = (b.column(i).to_pylist() for i in range(4))
            out = [surrogate(k, i, g, t, key) for k, i, g, t in zip(kinds, names, genders, tries)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=["kind", "item", "hint", "attempt", "stand_in"])

    schema = "kind string, item string, hint string, attempt int, stand_in string"
    drawn = staged(hinted_items.withColumn("attempt", F.lit(0)).mapInArrow(draw, schema), "surrogates")
    order = Window.partitionBy("kind", "stand_in").orderBy("attempt", "item")
    real = items.select(F.col("kind").alias("_kind"), F.col("item").alias("_item")).distinct()
    as_item = F.udf(canonical, "string")

    def placed(drawn: DataFrame) -> DataFrame:
        """With ``place`` 1 for those that stay."""
        ranked = drawn.withColumn("place", F.row_number().over(order)).withColumn("_as", as_item("kind", "stand_in"))
        ranked = ranked.join(real, (F.col("kind") == F.col("_kind")) & (F.col("_as") == F.col("_item")), "left")
        return staged(ranked.withColumn("place", F.when(F.col("_item").isNull(), F.col("place")).otherwise(2)).drop("_as", "_kind", "_item"), "placed")

    for _ in range(rounds):
        ranked = placed(drawn)
        again = ranked.where("place > 1")
        if again.isEmpty():
            return drawn.select("kind", "item", "stand_in")
        fresh = again.select("kind", "item", "hint", (F.col("attempt") + 1).alias("attempt")).mapInArrow(draw, schema)
        drawn = staged(ranked.where("place = 1").drop("place").unionByName(fresh), "surrogates")
    # what still collides after that many attempts is told apart by its own hash
    return placed(drawn).select("kind", "item", F.when(F.col("place") == 1, F.col("stand_in")).otherwise(F.concat("stand_in", F.lit("-"), F.sha2("item", 256))).alias("stand_in"))


def dressed(kind: str, stand_in: str, original: str) -> str:
    """The stand-in in the writing of one mention: its punctuation, its case, and the order of a name."""
    if kind in ("phone", "id_number"):
        new = iter(stand_in)
        if sum(c.isalnum() for c in original) == len(stand_in):
            return "".join(next(new) if c.isalnum() else c for c in original)
        return stand_in
    if kind == "name" and "," in original:
        given, family = stand_in.split(" ", 1)
        stand_in = f"{family}, {given}"
    return stand_in.upper() if kind != "email" and original.isupper() else stand_in


_TITLED = re.compile(rf"(?<!\w){_TITLE}(?P<name>{_LINK}{_PART})(?![\w])")


def _tied(raw: str, marks: list[dict], taken: list[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
    """Spans of family names behind a title whose whole name stands in the same document, with its stand-in's family name."""
    families = {m["item"].rsplit(" ", 1)[-1]: m["stand_in"].rsplit(" ", 1)[-1] for m in marks if m["kind"] == "name"}
    out = []
    for m in _TITLED.finditer(raw) if families else ():
        a, z = m.span("name")
        family = families.get(name_parts("x " + m.group("name"))[1])
        if family and not any(x < z and a < y for x, y in taken):
            out.append((a, z, "name", family))
    return out


def kept_words(items: DataFrame, table: DataFrame) -> DataFrame:
    """``(kind, kept)``: of how many items the stand-in holds a word or number of three characters or more of the item itself, but for kinds of streets."""
    words = lambda c: F.filter(F.split(F.lower(c), "[^\\p{L}\\p{N}]+"), lambda w: (F.length(w) > 2) & ~w.isin(*sorted(_STREET_WORDS), "example", "com", "net", "org"))
    both = items.select("kind", "item").distinct().join(table, ["kind", "item"])
    return both.groupBy("kind").agg(F.count_if(F.arrays_overlap(words(F.col("item")), words(F.col("stand_in")))).alias("kept"))


def redacted(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", metadata_col: str = "metadata_json") -> DataFrame:
    """``docs`` with each item in both fields replaced by ``[KIND:stand-in]``, all else unchanged.

    A family name alone behind a title is replaced too where the whole name stands in the same document.
    Ids must be unique and not null for a document's items to find it; others come out as they are where they have no items.
    Stand-ins hold no quotes, escapes or line ends, so JSON stays as valid as it was.
    """
    items = staged(personal_items(docs, id_col, text_col, metadata_col), "items")
    table = surrogates(items, key)
    marks = (
        items.join(table, ["kind", "item"])
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("field", "start_pos", "end_pos", "kind", "item", "stand_in")).alias("_marks"))
    )
    joined = docs.join(marks.withColumnRenamed("doc_id", "_marked"), docs[id_col].cast("long") == F.col("_marked"), "left")

    def run(batches):
        for b in batches:
            names = b.schema.names
            at = {f: names.index(f) for f in (text_col, metadata_col)}
            cols = list(b.columns)
            marks = b.column(names.index("_marks")).to_pylist()
            for f, i in at.items():
                values = b.column(i).to_pylist()
                for n, m in enumerate(marks):
                    if m and values[n]:
                        v = values[n]
                        own = [x for x in m if x["field"] == f]
                        spans = [(x["start_pos"], x["end_pos"], x["kind"], dressed(x["kind"], x["stand_in"], v[x["start_pos"] : x["end_pos"]])) for x in own]
                        spans += _tied(v, m, [x[:2] for x in spans])
                        for a, z, kind, new in sorted(spans, reverse=True):
                            v = f"{v[:a]}[{kind.upper()}:{new}]{v[z:]}"
                        values[n] = v
                cols[i] = pa.array(values, pa.string())
            keep = [i for i, c in enumerate(names) if c != "_marks"]
            yield pa.RecordBatch.from_arrays([cols[i] for i in keep], names=[names[i] for i in keep])

    rest = joined.drop("_marked")
    return rest.mapInArrow(run, docs.schema)
