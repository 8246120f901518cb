"""Personal data in free text, by anchor expansion.

One Aho-Corasick pass over each text finds the anchors: at-signs in their disguises, digit pairs, street words and given names. From
each anchor a small parser expands to the left and right and validates what it took: an email's local part and domain, a number's
grouping, an address from house number to city or postal code, a name's given name or initial and surname.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mnemark.session import cut

LETTER = r"[^\W\d_]"
GAP = "[ \t\xa0​\n]{1,4}"
#: Names up to which the lexicon is sent to all tasks whole; a larger one is joined with the words of the texts. No name is left out.
NAMES_BROADCAST = 100_000
# Words that follow a house number's street, that stand before it, and that end the name of an organisation.
STREETS = "road rd street st avenue ave lane ln court ct drive dr way close place pl square sq terrace boulevard blvd crescent gardens row hill".split()
STREETS_BEFORE = ["rue", "avenue", "boulevard", "place", "chemin", "impasse", "calle", "avenida", "plaza", "paseo", "carrera"]
ORG_WORDS = "bank press rail mill labs tours foods dental hardware insurance inc ltd llc gmbh group company partners university school club works committee survey foundation institute".split()
AT_SIGNS = ["@", "[at]", "(at)", "{at}", " at ", "＠"]
EMAIL, PHONE, ID_NUMBER, ADDRESS, NAME = "email", "phone", "id_number", "address", "name"

LOCAL_END = re.compile(r"[A-Za-z0-9][\w.%+\-]*(?:\s*[\[({]dot[\])}]\s*[\w%+\-]+| dot [\w%+\-]+)*$", re.I)
LOCAL_DOTTED = re.compile(r"(?:[A-Za-z0-9][\w.%+\-]*(?: dot | ?[\[({]dot[\])}] ?))+[\w.%+\-]+$|[A-Za-z0-9][\w.%+\-]*$", re.I)
DOMAIN = re.compile(r"[A-Za-z0-9][A-Za-z0-9\-]*(?:(?:\.| ?[\[({]dot[\])}] ?| dot )[A-Za-z0-9][A-Za-z0-9\-]*)+", re.I)
AT = re.compile(r"\s?[\[({]at[\])}]\s?|@|＠| at ", re.I)
EXTENSION = r"(?: ?(?:ext\.?|extension|x|poste|Durchwahl|Dw\.?) ?\d{1,5}(?!\d))?"
PHONES = re.compile(
    r"(?<![\w+./\-])(?:"
    r"\+\d{1,3}[ .\-]?(?:\(0\) ?)?(?:\(\d{1,4}\)[ .\-]?)?\d(?:[ .\-/]?\d){5,12}"
    r"|(?:1[ .\-])?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}"
    r"|0\d(?:[ .\-]\d\d){4}"
    r"|0\d{2} \d{4} \d{4}|0\d{3} \d{3} \d{4}|0\d{4} \d{6}"
    r"|0\d{2,4}[/\-]\d{5,9}"
    r")(?!\d)" + EXTENSION + r"(?![\w]|[\-./]\d)"
)
IDS = re.compile(
    r"(?<![\w+./\-])(?:"
    r"[1-4] ?\d\d ?\d\d ?\d[\dAB] ?\d{3} ?\d{3} ?\d\d"
    r"|\d{3}([ \-])\d{2}\1\d{4}"
    r"|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]"
    r"|[A-Z]\d{3}-\d{4}-\d{4}"
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|[A-Z]{1,2}\d{7,8}"
    r")(?![\w]|[\-./]\d)"
)
RUN = re.compile(r"[A-Z0-9+()\[\]./\- \xa0x]*")
WORD = rf"{LETTER}[\w'’\-]*"
CITY = rf"(?=[^\W\d_a-zß-ÿ]){WORD}"
COMMA = r",[ \n]{1,2}"
ADDRESSES = re.compile(
    rf"(?<![\w])(?:\d{{1,5}}[a-zA-Z]?,? (?:{CITY} ){{1,3}}?(?i:{'|'.join(STREETS)})\b\.?(?:,? (?i:apt|apartment|unit|suite|flat|no)\.? ?\d\w{{0,5}})?(?:{COMMA}|\n){CITY}(?:,? (?:[A-Z]{{2}} )?\d{{5}}(?:-\d{{4}})?(?!\d))?"
    rf"|\d{{1,5}}(?: ?bis| ?ter)?,? (?i:rue|avenue|boulevard|place|chemin|impasse) (?:(?:du|de|des|la|le|de la|d'|l') ?)*{WORD}(?:{COMMA}|\n)\d{{5}} {CITY}"
    rf"|{WORD}(?i:stra(?:ß|ss)e|str\.|weg|platz|gasse|allee) \d{{1,4}}[a-z]?(?:{COMMA}|\n)\d{{5}} {CITY}"
    rf"|(?i:calle|avenida|plaza|paseo|carrera) (?:(?:de|del|la|las|los) )*{WORD}(?:,| n\.?º)? \d{{1,4}}(?:{COMMA}|\n)(?:\d{{5}} )?{CITY}(?: \d{{5}}(?!\d))?"
    r")"
)
INITIAL = re.compile(rf"(?<![\w.])[^\W\d_a-zß-ÿ]\.{GAP}(?={LETTER})")
NEXT_WORD = re.compile(rf"(?:{GAP}([^\W\d_])\.?(?={GAP}))?{GAP}({LETTER}{{2,}}(?:['’\-]{LETTER}+)*)")
RUN_OF_LETTERS = re.compile(rf"{LETTER}(?:{LETTER}|['’\-])+")
ONE_WORD = re.compile(rf"{LETTER}{{2,}}(?:['’\-]{LETTER}+)*")
SURNAME_BEFORE = re.compile(rf"({LETTER}{{2,}}(?:['’\-]{LETTER}+)*),{GAP}$")
#: Widest text taken on one side of an anchor: a local part has at most 64 characters, a street line not more than 120.
REACH = 160
#: More than the longest number with its extension.
LONGEST = 64


@lru_cache(1)
def _plain() -> dict[int, str]:
    """Accented Latin letters to their base letter, one for one, so that positions stay."""
    return {c: b for c in range(0xC0, 0x250) if (b := unicodedata.normalize("NFKD", chr(c).lower())[0]) and len(chr(c).lower()) == 1}


def fold(text: str) -> str:
    low = text.lower()
    return (low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)).translate(_plain()) if not text.isascii() else low


class Finder:
    """Anchors and parsers for one pair of name lexicons (folded given names and surnames)."""

    def __init__(self, given: list[str], surnames: list[str]) -> None:
        self.given, self.surnames = set(given), set(surnames)
        self.automaton = ahocorasick.Automaton()
        words = [(a, EMAIL) for a in AT_SIGNS] + [(f"{n:02d}", PHONE) for n in range(100)] + [(g, NAME) for g in self.given if len(g) > 1]
        words += [(f" {s}", ADDRESS) for s in STREETS] + [(f"{s} ", ADDRESS) for s in STREETS_BEFORE] + [(s, ADDRESS) for s in ("strasse ", "straße ", "strase ", "str. ", "weg ", "platz ", "gasse ", "allee ")]
        for w, kind in words:
            self.automaton.add_word(w, (kind, len(w)))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, type), in order and without overlap: emails first, then identity numbers, phones, addresses, names."""
        low, found, numbers, streets = fold(text), [], [], []
        for end, (kind, n) in self.automaton.iter(low):
            start = end + 1 - n
            if kind == PHONE:
                if not numbers or start >= numbers[-1][1]:
                    numbers.append(self._run(text, start))
            elif kind == EMAIL:
                if s := self._email(text, start):
                    found.append((*s, EMAIL))
            elif kind == NAME:
                if s := self._name(text, low, start, end + 1):
                    found.append((*s, NAME))
            else:
                streets.append(start)
        for a, b in numbers:
            found += [(m.start(), m.end(), ID_NUMBER) for m in IDS.finditer(text, a, b + LONGEST) if m.start() < b]
            found += [(m.start(), m.end(), PHONE) for m in PHONES.finditer(text, a, b + LONGEST) if m.start() < b and self._phone(m[0])]
        done = 0
        for s in streets:
            if s >= done:
                for m in ADDRESSES.finditer(text, max(done, s - REACH), s + REACH):
                    if m.start() <= s + 1 and s < m.end():
                        found.append((m.start(), m.end(), ADDRESS))
                        done = m.end()
        if "." in text:
            for m in INITIAL.finditer(text):
                w = ONE_WORD.match(text, m.end())
                if w and fold(w[0]) in self.surnames and w[0][0].isupper() and not self._org(text, w.end()):
                    found.append((m.start(), w.end(), NAME))
        order = {EMAIL: 0, ID_NUMBER: 1, PHONE: 2, ADDRESS: 3, NAME: 4}
        out: list[tuple[int, int, str]] = []  # sorted, without overlap: only the neighbours of a new span can touch it
        for s in sorted(set(found), key=lambda x: (order[x[2]], x[0] - x[1], x[0])):
            i = bisect(out, s[:2], key=lambda x: x[:2])
            if (i == 0 or out[i - 1][1] <= s[0]) and (i == len(out) or s[1] <= out[i][0]):
                out.insert(i, s)
        return out

    @staticmethod
    def _run(text: str, at: int) -> tuple[int, int]:
        """The stretch of digits and their punctuation around an anchor."""
        left = max(0, at - 40)
        a = at
        while a > left and text[a - 1] in "0123456789+()[]./- \xa0XYZABCDEFGHIJKLMNOPQRSTUVW":
            a -= 1
        return a, min(len(text), RUN.match(text, at).end() + 12)

    @staticmethod
    def _email(text: str, at: int) -> tuple[int, int] | None:
        at = at - 1 if at and text[at] in "[({" and text[at - 1] == " " else at
        sign = AT.match(text, at)
        if not sign:
            return None
        domain = DOMAIN.match(text, sign.end())
        word = sign[0] == " at "
        left = text[max(0, at - REACH) : at]
        local = (LOCAL_DOTTED if word or " dot " in left[-70:].lower() or "dot" in sign[0] else LOCAL_END).search(left)
        if not domain or not local or (word and " dot " not in domain[0].lower() and "dot]" not in domain[0].lower()):
            return None
        return at - len(local[0]), domain.end()

    @staticmethod
    def _phone(text: str) -> bool:
        digits = len(re.sub(r"\D", "", re.split(r"[a-zA-Z]", text)[0]))
        return 7 <= digits <= 15

    def _org(self, text: str, end: int) -> bool:
        w = ONE_WORD.match(text, end + 1) if end < len(text) and text[end] in " \xa0" else None
        return bool(w) and w[0].lower() in ORG_WORDS

    def _name(self, text: str, low: str, start: int, end: int) -> tuple[int, int] | None:
        edge = lambda c: not (c.isalnum() or c in "_@.-+'’")
        if (start and not edge(text[start - 1])) or (end < len(text) and (text[end].isalnum() or text[end] in "_@-+'’")):
            return None
        if m := SURNAME_BEFORE.search(text, max(0, start - 60), start):
            if fold(m[1]) in self.surnames:
                tail = re.compile(rf"{GAP}[^\W\d_a-zß-ÿ]\.(?!\w)").match(text, end)
                return m.start(), (tail.end() if tail and not self._follows(text, end) else end)
        m = NEXT_WORD.match(text, end)
        if not m:
            return None
        w = m[2]
        known = fold(w) in self.surnames
        shaped = text[start].isupper() and text[start:end] != text[start:end].upper() and w[0].isupper() and w[1:].islower() and w.lower() not in ORG_WORDS + STREETS and fold(w) not in self.given and "\n" not in m[0]
        return (start, m.end()) if (known or shaped) and not self._org(text, m.end()) else None

    def _follows(self, text: str, end: int) -> bool:
        m = NEXT_WORD.match(text, end)
        return bool(m) and fold(m[2]) in self.surnames


def name_table(names: DataFrame, name: str) -> DataFrame:
    """(k, given): each folded given name (given = true) and surname of `name` written as "Given [X.] Surname" or "Surname, Given",
    once, however rare it is. Initials, and names of one part, give nothing."""
    n = F.trim(F.regexp_replace(F.col(name), r"[\s\x{A0}]+", " "))
    swapped = F.regexp_replace(n, r"^([^,]+), *(.+)$", "$2 $1")
    parts = names.select(F.split(swapped, " ").alias("p")).filter(F.size("p") >= 2)
    parts = parts.select(F.explode(F.array(*(F.struct(F.lower(c).alias("k"), F.lit(g).alias("given")) for c, g in ((F.col("p")[0], True), (F.element_at("p", -1), False))))).alias("x")).select("x.*")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([fold(k) for k in b.column(0).to_pylist()], pa.string()), b.column(1)], names=["k", "given"])

    return parts.filter(F.col("k").rlike(r"^\p{L}[\p{L}'’-]+$")).distinct().mapInArrow(folded, "k string, given boolean").distinct()


def name_lexicons(names: DataFrame, name: str) -> tuple[list[str], list[str]]:
    """All given names and all surnames of name_table, as lists on the driver."""
    return _lists(name_table(names, name).collect())


def _lists(rows: list) -> tuple[list[str], list[str]]:
    return sorted(k for k, given in rows if given), sorted(k for k, given in rows if not given)


_finders: dict[bytes, Finder] = {}


def digest(lexicons: tuple[list[str], list[str]]) -> bytes:
    return hashlib.blake2b("\n\n".join("\n".join(names) for names in lexicons).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _finder(content: bytes, shared) -> Finder:  # noqa: ANN001
    """The finder of the broadcast lexicons, made once in a worker; their content tells whether it is the one at hand."""
    if content not in _finders:
        _finders.clear()
        _finders[content] = Finder(*shared.value)
    return _finders[content]


def _mapped(df: DataFrame, id_col: str, text: str, lexicons: tuple[list[str], list[str]] | DataFrame, schema: str, rows) -> DataFrame:  # noqa: ANN001
    """rows(finder, batch) over (id, text); lexicons: two lists, or a name_table of any size."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    if isinstance(lexicons, DataFrame):
        # One row more than the limit tells whether the table is larger.
        head = (lexicons := cut(lexicons)).limit(NAMES_BROADCAST + 1).collect()
        if len(head) > NAMES_BROADCAST:
            return _joined(texts, lexicons, schema, rows)
        lexicons = _lists(head)
    shared, content = df.sparkSession.sparkContext.broadcast(lexicons), digest(lexicons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(content, shared)
        for b in batches:
            yield rows(finder, b)

    return texts.mapInArrow(run, schema)


def name_words(text: str) -> set[str]:
    """All folded words of a text that a Finder may look up in its lexicons."""
    low = fold(text)
    return {w for r in (RUN_OF_LETTERS, ONE_WORD) for w in r.findall(low)}


def _joined(texts: DataFrame, names: DataFrame, schema: str, rows) -> DataFrame:  # noqa: ANN001
    """As _mapped, with a lexicon that stays a table: each text gets the names that its words are, by a join on the words. A batch's
    finder knows the names of all its texts, which for each of them finds what the whole lexicon would find."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, k = [], []
            for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                new = name_words(t)
                h += [x] * len(new)
                k += new
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.string()), pa.array(k, pa.string())], names=["h", "k"])

    keyed = texts.withColumn("h", F.sha2("text", 256))
    said = keyed.filter("text IS NOT NULL").select("h", "text").mapInArrow(words, "h string, k string").distinct()
    has = said.join(names, "k").groupBy("h").agg(F.collect_list(F.when(F.col("given"), F.col("k"))).alias("given"), F.collect_list(F.when(~F.col("given"), F.col("k"))).alias("surnames"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given, surnames = (sorted({k for ks in b.column(c).to_pylist() for k in ks or ()}) for c in (2, 3))
            yield rows(Finder(given, surnames), b)

    return keyed.join(has, "h", "left").select("id", "text", "given", "surnames").mapInArrow(run, schema)


def found(df: DataFrame, id_col: str, text: str, lexicons: tuple[list[str], list[str]] | DataFrame) -> DataFrame:
    """(id, pii_type, pii_text): each distinct piece of personal data of each text, as written. Null and empty texts give no rows;
    texts are read whole, whatever their length; repeated rows give their pieces once for each."""

    def rows(finder: Finder, b: pa.RecordBatch) -> pa.RecordBatch:
        ids, kinds, texts = [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for kind, piece in sorted({(k, t[a:e]) for a, e, k in finder.spans(t)}) if t else ():
                ids.append(i), kinds.append(kind), texts.append(piece)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=["id", "pii_type", "pii_text"])

    return _mapped(df, id_col, text, lexicons, "id long, pii_type string, pii_text string", rows)


def redacted(df: DataFrame, id_col: str, text: str, lexicons: tuple[list[str], list[str]] | DataFrame) -> DataFrame:
    """(id, redacted, pieces): the text with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS], [NAME] for each piece and nothing else changed.
    A null text stays null."""

    def rows(finder: Finder, b: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts = [], []
        for t in b.column(1).to_pylist():
            spans = finder.spans(t) if t else []
            out, at = [], 0
            for a, e, k in spans:
                out += [t[at:a], f"[{k.upper()}]"]
                at = e
            texts.append("".join([*out, t[at:]]) if t is not None else None)
            counts.append(len(spans))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["id", "redacted", "pieces"])

    return _mapped(df, id_col, text, lexicons, "id long, redacted string, pieces int", rows)
