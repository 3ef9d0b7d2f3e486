"""Personal information in free text: anchors by Aho-Corasick, boundaries by local parsers.

Names are no list: given names are learned from the collection's own headers, titles, mentions and
signatures, and pairs of capitalised words count unless the collection shows them to be a fixed term.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.operators.skew import salted_join
from lodeweave.session import cut

GIVEN_SHARE = 2.0**-14  # a given name is learned if it leads this share of the announced names: at most 2**14 are
FIXED = 3  # a pair of capitalised words seen so often is a term if its first word has no other partner as often

# Words of general language that announce a person, in English, German, French and Spanish.
BEFORE_PERSON = [
    "attendees:", "participants:", "present:", "teilnehmer:", "présents:", "asistentes:", "from:", "to:", "cc:", "bcc:", "von:", "an:", "de:", "para:",
    "reviewed by ", "approved by ", "signed by ", "written by ", "prepared by ", "checked by ", "according to ", "agreed with ", "action on ", "contact ", "owner = ", "owner: ", "author: ", "contact: ",
    "thx ", "thanks ", "dear ", "hello ", "hi ", "regards,", "geprüft von ", "freigegeben von ", "laut ", "relu par ", "approuvé par ", "selon ", "revisado por ", "aprobado por ", "según ", "\n--",
    "dr. ", "mr. ", "mrs. ", "ms. ", "prof. ", "frau ", "herrn ", "herr ", "m. ", "mme ", "sra. ", "sr. ",
]
TITLES = {"dr. ", "mr. ", "mrs. ", "ms. ", "prof. ", "frau ", "herrn ", "herr ", "m. ", "mme ", "sra. ", "sr. "}  # with a capital only
STREET = ["street", "st", "st.", "road", "rd", "lane", "ln", "avenue", "ave", "court", "ct", "blvd", "boulevard", "drive", "dr", "way", "place", "square", "terrace", "straße", "strasse", "str.", "weg", "platz", "allee", "rue ", "chemin ", "calle ", "avenida ", "plaza ", "paseo ", "po box", "p.o. box", "postfach", "apartado", "boîte postale", "bp "]
COMPOUND = {"straße", "strasse", "weg", "platz", "allee"}  # may end a longer word
SMALL = {"rue ", "chemin ", "avenue", "boulevard", "place", "postfach", "po box", "p.o. box", *COMPOUND}  # may be written small
IDENTIFIER = ["passport", "ssn", "tax no", "tax id", "steuer-id", "ausweisnummer", "dni", "pasaporte", "pièce d'identité", "badge", "insurance no", "personalausweis", "personnel no", "staff no", "employee id", "employee no", "national id", "licence no"]
# Words that begin a sentence rather than a name, and words that make what they stand with no person.
CLOSED = set(
    "the a an our we it he she they you i for if in at on by to of two one this that these those with from and or but not no as is was are were please after before during while when where what who how why because since once both each every all any some many most more other another new old first second last next let keep see call ask "
    "der die das den dem des ein eine einen einem einer im am zum zur vom beim in an auf mit von nach bei für und oder nicht wir sie es er laut bitte diese dieser dieses ende anfang "
    "le la les un une des du de au aux en dans par pour avec sur et ou ne pas ce cette ces il elle nous vous on selon "
    "el los las una unos del al en por para con sobre y o no se su este esta estos según".split()
)
LABELS = set(
    "project program programme plan row column bank pad figure fig table sheet lot cell net rail order item model part section chapter page appendix revision version build batch "
    "street st road rd lane ln avenue ave court ct blvd boulevard drive way place square terrace park bridge river lake mount monte port cape saint san santa north south east west new upper lower great "
    "group team platform department dept institute university college school company corporation corp inc ltd gmbh bank office laboratory lab center centre committee council ministry society association journal press conference workshop "
    "set law effect theorem plot diagram curve trigger transform equation method model test filter amplifier cell bridge circuit current voltage stage noise spread "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday januar februar märz mai juni juli oktober dezember".split()
)

L = r"[^\W\d_]"
UP, LOW = r"[A-ZÀ-ÖØ-Þ]", r"[a-zß-öø-ÿ]"
_PARTICLE = r"(?:(?:van der|van den|von der|van|von|de la|de|del|della|di|da|dos|ten|ter|VAN DER|VON DER|VAN|VON|DE LA|DE|DEL|DI|DA) )?"
_SUR = rf"(?:(?:O'|Mc|Mac|D'|al-|Al-|el-|AL-)?(?:{UP}{LOW}+(?:-{UP}{LOW}+)*|{UP}{{2,}}(?:-{UP}{{2,}})*))"
_SURLOW = rf"{LOW}{{3,}}(?:-{LOW}+)*"
_GIV = rf"(?:{UP}{LOW}+(?:-{UP}{LOW}+)?|{UP}{{2,}}(?:-{UP}{{2,}})?)"
_MID = rf"(?: {UP}\.)?"
SURNAME_AFTER = re.compile(rf"{_MID} {_PARTICLE}{_SUR}")
SURNAME_LOWER = re.compile(rf"(?: {LOW}\.)? (?:(?:van der|von der|van|von|de la|de|del|di|da) )?({_SURLOW})")
SURNAME_BEFORE = re.compile(rf"(?<![\w.-]){_PARTICLE}{_SUR}, $")
NAME = re.compile(rf"(?:{_PARTICLE}{_SUR}, {_GIV}{_MID}|(?:{UP}\. ?){{1,2}}{_PARTICLE}{_SUR}|{_GIV}{_MID} {_PARTICLE}{_SUR})(?![\w@])")
# A pair of words written like a name: an initial or a capitalised word, then a capitalised one.
SHAPE = re.compile(rf"(?<![\w.@/-])(?:(?:{UP}\. ?){{1,2}}|{UP}{LOW}+(?:-{UP}{LOW}+)?{_MID} ){_PARTICLE}(?:O'|Mc|Mac|D'|al-|Al-|el-)?{UP}{LOW}+(?:-{UP}{LOW}+)*(?![\w@])")
_CAPITAL = re.compile(rf" {UP}[\w'’-]*")
_GERMAN = re.compile(r"\b(?:der|die|das|und|wird|nicht)\b")
TITLE = re.compile(r"(?:(?:Dr|Prof|Mr|Mrs|Ms|Frau|Herrn?|Mme|Sra|Sr|Ing)\.? )+(?=\S)")

LOCAL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._+-]*[A-Za-z0-9])?$")
DOT = r"(?:\.|\[dot\]|\(dot\)| \[dot\] | \(dot\) | dot )"
DOMAIN = re.compile(rf"[A-Za-z0-9][A-Za-z0-9-]*(?:{DOT}[A-Za-z0-9][A-Za-z0-9-]*)*?{DOT}[A-Za-z]{{2,}}(?:{DOT}[A-Za-z]{{2,}})*(?![\w])", re.I)
ATS = ["@", "[at]", "(at)"]

EXT = r"(?:,? ?(?:ext\.?|x|Durchwahl|poste) ?\d{1,5})?"
PHONE = re.compile(
    r"(?:\+[1-9]\d{0,2}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ ./-]?\d{2,8}){1,5}"
    r"|00[1-9]\d{0,2}[ .-](?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ ./-]?\d{2,8}){1,5}"
    r"|(?:1[ .-])?\([2-9]\d\d\) ?\d{3}[ .-]\d{4}"
    r"|(?:1[ .-])?[2-9]\d\d([ .-])[2-9]\d\d\1\d{4}"
    r"|[2-9]\d\d[2-9]\d{6}"
    r"|0\d([ .-])\d\d(?:\2\d\d){3}"
    r"|0\d{2,4}(?:/| / )\d{3,8}(?:[ -]\d{1,6})?"
    r"|(?:\(0\d{2,4}\)|0\d{2,4}) \d{3,4} \d{3,4})" + EXT + r"(?![\w<]|[./-]\d)"
)
ID = re.compile(
    r"(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|9\d{8}|\d{6}/\d{4}|\d{8}[A-Z]|\d{2}\.\d{3}\.\d{3}-[A-Z0-9]"
    r"|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[A-Z]{2}\d{7}|[A-Z]\d{4}<\d{4}|[A-Z]\d[A-Z]\d\d[A-Z]\d{4})(?![\w<]|[./-]\d)"
)
CUED_ID = re.compile(r"(?:\.|:|-ID|nummer)?(?: no\.?| number| nr\.?)?:? ?([A-Z0-9](?:[A-Z0-9./<-]*\d){5,}[A-Z0-9]*)(?![\w])")

_WORD = rf"{UP}[\w'’-]*"
_TOWN = rf"{UP}[\w'’-]+(?: (?!{UP}{LOW}+ (?:the|a|an|of)\b){UP}{LOW}[\w'’-]*)?"
_TAIL = r"(?:, (?:Apt|Unit|Suite|Flat|Room) \w+)?"
_PLACE = rf"(?:(?:, ?|\r?\n)(?:(?:[A-Z]-)?\d{{4,5}} {_TOWN}|{_TOWN} \d{{4,5}}(?!\d)|(?<=, ){_TOWN}))?"
KINDS = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Court|Ct|Blvd|Boulevard|Drive|Dr|Way|Place|Square|Terrace)"
ADDRESSES = [
    re.compile(rf"(?:(?:Unit|Apt|Suite|Flat) \w+, )?\d+(?:-\d+)?[a-z]? (?:[NSEW]\. )?(?:{_WORD} ){{1,3}}?{KINDS}\b\.?{_TAIL}{_PLACE}"),
    re.compile(rf"\d+(?: (?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin) (?:(?:du|de la|de|des|d') ?)?{_WORD}(?: {_WORD})?{_PLACE}"),
    re.compile(rf"(?:Calle|Avenida|Plaza|Paseo) (?:de )?{_WORD}(?: {_WORD})? \d+(?:, \d+º ?\w*)?{_PLACE}"),
    re.compile(rf"{_WORD}(?:straße|strasse|weg|platz|allee) \d+ ?[a-z]?{_PLACE}"),
    re.compile(rf"{_WORD} (?:Str\.|Straße|Strasse|Allee|Platz|Weg) \d+ ?[a-z]?{_PLACE}"),
    re.compile(rf"(?:(?i:P\.?O\.? Box|Postfach|Apartado|Boîte postale)|BP) \d+{_PLACE}"),
]
LABEL = re.compile(r"(?:Row|Column|Bank|Pad|Figure|Table|Sheet|Lot|Cell|Net|Rail) $", re.I)
COUNTED = re.compile(r"\b(?:order|serial|part|invoice|item|article|lot|batch|ticket|case|version|step|seed|sample|build|row)(?: (?:number|no\.?|nr\.?|id))?[ :#]+$", re.I)
PRIORITY = {"email": 0, "address": 1, "id_number": 2, "phone": 3, "person": 4}


@lru_cache(maxsize=4)
def automaton(given: tuple[str, ...] = ()):
    """All anchors in one Aho-Corasick automaton; ``given`` are the given names learned."""
    import ahocorasick

    a = ahocorasick.Automaton()
    kinds: dict[str, set] = {}
    for kind, keys in (("at", ATS), ("given", given), ("before", BEFORE_PERSON), ("street", STREET), ("cue", IDENTIFIER), ("digit", [*"0123456789", "+", "("])):
        for k in keys:
            kinds.setdefault(k, set()).add(kind)
    for k, v in kinds.items():
        a.add_word(k, (len(k), tuple(sorted(v))))
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def _announcing():
    """The anchors that announce a person only."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for k in (*BEFORE_PERSON, "@"):
        a.add_word(k, len(k))
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


_INSIDE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._+-")


def _email(text, start, end):
    left = start
    while left and text[left - 1] == " " and start - left < 2:
        left -= 1
    right = end
    while right < len(text) and text[right] == " " and right - end < 2:
        right += 1
    if (left != start) != (right != end):
        return None
    begin = left
    while begin and text[begin - 1] in _INSIDE:
        begin -= 1
    local = LOCAL.search(text, begin, left)
    if not local or local.end() != left:
        return None
    domain = DOMAIN.match(text, right)
    return (local.start(), domain.end()) if domain else None


def _back(text, at, words):
    """Where the ``words`` words before ``at`` begin, within its line."""
    begin = text.rfind("\n", 0, at) + 1
    while words and at > begin:
        at = max(begin, text.rfind(" ", begin, max(begin, at - 1)) + 1)
        words -= 1
    return at


def _person_given(text, start, end):
    """A name with a learned given name: (start, end, whether it is written in small letters)."""
    if (start and (text[start - 1].isalnum() or text[start - 1] in "_.-")) or (end < len(text) and (text[end].isalnum() or text[end] in "_-")):
        return None
    word = text[start:end]
    if word.islower():
        m = SURNAME_LOWER.match(text, end)
        if m and m.group(1) not in CLOSED and not (m.end() < len(text) and text[m.end()] in "@_"):
            return start, m.end(), True
        return None
    m = SURNAME_BEFORE.search(text, _back(text, start, 5), start)
    if m:
        return m.start(), end, False
    m = SURNAME_AFTER.match(text, end)
    return (start, m.end(), False) if m and _named(text, start, m.end()) else None


_AHEAD = re.compile(r"\S*(?:\s+\S+){0,10}")  # no grammar goes on for more words after its street word


def _street(text, start, end, found):
    """Addresses whose street word is at start: each grammar is tried from the words before it that it can begin with, at most nine."""
    begin, until = _back(text, start, 9), _AHEAD.match(text, end).end()
    for rx in ADDRESSES:
        at = begin
        while True:
            m = rx.search(text, at, until)
            if not m or m.start() > start:
                break
            if m.end() >= end and not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in ".-")) and not LABEL.search(text, max(0, m.start() - 10), m.start()):
                found.append(("address", m.start(), m.end()))
                return
            at = m.start() + 1


_GAP = re.compile(r"[ ]?\r?\n\|[-| :]*\r?\n|[ ]?\r?\n\| ?|[ ]?\r?\n|[ ]*")
_NEXT = re.compile(r"; ?\s?|, (?=[^,;\n]+,|[^,;\n]+ (?:and|und|et|y) )")


def _people_after(text, at, found):
    """Names that follow a cue: one, or a list separated by semicolons."""
    at = _GAP.match(text, at).end()
    if text.startswith("| ", at):
        at += 2
    while True:
        t = TITLE.match(text, at)
        if t:
            at = t.end()
        n = NAME.match(text, at)
        if not n or not _named(text, n.start(), n.end()):
            return
        found.append(("person", n.start(), n.end()))
        sep = _NEXT.match(text, n.end())
        if not sep:
            return
        at = sep.end()


def _named(text, start, end):
    """No word of it begins sentences or labels things."""
    first, *rest = re.findall(r"[\w'’-]+", text[start:end].lower())
    return (len(first) == 1 or first not in CLOSED and first not in LABELS) and not any(w in LABELS or w in CLOSED for w in rest[-1:])


def _shaped(text, found, german):
    """Pairs of words written like a name."""
    at = 0
    while True:
        m = SHAPE.search(text, at)
        if not m:
            return
        words = m.group(0).replace(".", ". ").split()
        first, last = words[0].lower(), words[-1].lower()
        if first in LABELS or last in LABELS:
            at = m.end()
            while n := _CAPITAL.match(text, at):  # what is named so far is no person
                at = n.end()
            continue
        if last in CLOSED or (first[1:2] == "." and text[m.start() - 2 : m.start() - 1].isdigit()):  # a unit or an initial at the end of a sentence
            at = m.start() + len(words[0])
            continue
        if first in CLOSED or text[m.start() :].startswith(("Frau ", "Herr ", "Herrn ", "Mme ")):
            at = m.start() + len(words[0])
            continue
        n = _CAPITAL.match(text, m.end())
        if n and n.group(0)[1:].lower() in LABELS:
            at = n.end()
            continue
        if not german:
            found.append(("person", m.start(), m.end()))
        at = m.end()


def announced(text: str | None) -> list[tuple[str, str]]:
    """(given name in small letters, surname in small letters) of the names that a header, title, mention or signature announces."""
    if not text:
        return []
    low, people = _lower(text), []
    for last, size in _announcing().iter(low):
        start = last - size + 1
        if size == 1:
            if start and (text[start - 1].isalnum() or text[start - 1] in "._ "[:2]):
                continue
        elif low[start : last + 1] in TITLES and not text[start].isupper() or text[start - 1 : start].isalnum() and low[start].isalpha():
            continue
        _people_after(text, last + 1, people)
    return [_parts(text[s:e]) for _, s, e in people]


def _parts(name: str) -> tuple[str, str]:
    """Given name and surname of a name in either order, small letters."""
    low = name.lower()
    if ", " in low:
        last, first = low.split(", ", 1)
        return first.split(" ")[0], last.split(" ")[-1]
    ws = low.replace(".", ". ").split()
    return ws[0], ws[-1]


def weighed(text: str | None, given: tuple[str, ...] = ()) -> list[tuple[str, int, int, str]]:
    """(type, start, end, evidence) of every finding, in order, none overlapping another.

    evidence: "sure" for what its form, an announcement, a given name or an email of the same text
    confirms; "shape" for a pair of words only written like a name; "small" for a known given name in
    small letters with a word after it."""
    if not text:
        return []
    low = _lower(text)
    found: list[tuple[str, int, int]] = []
    small: list[tuple[str, int, int]] = []
    skip = 0
    for last, (size, kinds) in automaton(given).iter(low):
        start, end = last - size + 1, last + 1
        for kind in kinds:
            if kind == "digit":
                if start < skip:
                    continue
                prev = text[start - 1] if start else " "
                if prev.isdigit():
                    continue
                if prev.isalpha() or prev == "<":
                    s = start  # identifiers may begin with letters
                    while s and text[s - 1].isalpha() and start - s < 2:
                        s -= 1
                    if text[s - 1 : s].isalnum() or text[s - 1 : s] in ("_", "-"):
                        continue
                    m = ID.match(text, s)
                    if m:
                        found.append(("id_number", s, m.end()))
                        skip = m.end()
                    continue
                if prev in ".-_" and text[start - 2 : start - 1].isalnum() or prev == "/" and text[start - 2 : start - 1].isdigit():
                    continue
                m = ID.match(text, start - 3) if start >= 3 and prev == " " and text[start - 3 : start - 1].isalpha() and text[start - 3 : start - 1].isupper() and not text[start - 4 : start - 3].isalnum() else None
                m = m or ID.match(text, start)
                if m and not (m.group(0).isdigit() and COUNTED.search(text, _back(text, start, 3), start)):
                    found.append(("id_number", m.start(), m.end()))
                    skip = m.end()
                    continue
                m = PHONE.match(text, start)
                if m and sum(c.isdigit() for c in m.group(0)) >= 9 and not (m.group(0).isdigit() and COUNTED.search(text, _back(text, start, 3), start)):
                    found.append(("phone", start, m.end()))
                    skip = m.end()
            elif kind == "at":
                e = _email(text, start, end)
                if e:
                    found.append(("email", *e))
                elif size == 1 and not text[start - 1 : start].isalnum():
                    _people_after(text, end, found)
            elif kind == "given":
                p = _person_given(text, start, end)
                if p:
                    (small if p[2] else found).append(("person", p[0], p[1]))
            elif kind == "street":
                apart = text[start:end].endswith((" ", "."))
                if (apart or not text[end : end + 1].isalnum()) and (low[start:end] in COMPOUND or not text[start - 1 : start].isalnum()) and (text[start].isupper() or low[start:end] in SMALL):
                    _street(text, start, end, found)
            elif kind == "before":
                title = low[start:end] in TITLES and not text[start].isupper()
                if not title and (not text[start - 1 : start].isalnum() or not low[start].isalpha()):
                    _people_after(text, end, found)
            elif kind == "cue":
                m = CUED_ID.match(text, end)
                if m and not text[start - 1 : start].isalnum():
                    found.append(("id_number", m.start(1), m.end(1)))
    shaped: list[tuple[str, int, int]] = []
    _shaped(text, shaped, len(_GERMAN.findall(text)) * 400 > len(text))
    locals_ = " ".join(low[s:e].split("@")[0] for k, s, e in found if k == "email")
    kept = []
    for evidence, group in (("sure", found), ("small", small), ("shape", shaped)):
        for k, s, e in group:
            sure = evidence == "sure" or (locals_ and len(x := _parts(text[s:e])[1]) > 3 and x in locals_)
            kept.append((k, s, e, "sure" if sure else evidence))
    return _settle(kept)


def find(text: str | None, given: tuple[str, ...] = ()) -> list[tuple[str, int, int]]:
    """(type, start, end) of every finding of a text on its own, by whatever evidence, with no collection to tell fixed terms."""
    return [f[:3] for f in weighed(text, given)]


def _settle(found):
    """Of overlapping findings the one of the stronger kind, then the surer, then the longer, stays."""
    starts: list[int] = []
    taken: list[tuple[str, int, int, str]] = []
    for f in sorted(set(found), key=lambda f: (PRIORITY[f[0]], f[3] != "sure", -(f[2] - f[1]), f[1])):
        i = bisect_left(starts, f[1])
        if (i == 0 or taken[i - 1][2] <= f[1]) and (i == len(taken) or f[2] <= taken[i][1]):
            starts.insert(i, f[1])
            taken.insert(i, f)
    return taken


def redact(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    """The text with each finding replaced by its type in brackets."""
    if not found:
        return text
    out, at = [], 0
    for kind, start, end in found:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def _learn(batches):
    for batch in batches:
        n: Counter = Counter()
        for t in batch.column("text").to_pylist():
            n.update({g for g, _ in announced(t)})
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["given", "n"])


def given_names(documents: DataFrame, share: float = GIVEN_SHARE) -> tuple[str, ...]:
    """Given names that lead at least two announced names of the collection, and ``share`` of them all, by whole texts: at most 1 / share."""
    every = documents.select("text").filter("text is not null").mapInArrow(_learn, "given string, n bigint").groupBy("given").agg(F.sum("n").alias("n")).filter("n > 1 and length(given) > 2 and given not like '%.'")
    total = every.agg(F.sum("n")).scalar()
    return tuple(sorted(r.given for r in every.filter(F.col("n") >= F.lit(share) * total).collect() if r.given not in CLOSED and r.given not in LABELS))


_ROW = "key bigint, pii_type string, start_pos bigint, end_pos bigint, evidence string, a string, b string"


def _rows(batches, held):
    given = held.value
    for batch in batches:
        at, out = [], []
        for i, t in enumerate(batch.column("text").to_pylist()):
            for k, s, e, how in weighed(t, given):
                a, b = _parts(t[s:e]) if k == "person" else (None, None)
                at.append(i)
                out.append((k, s, e, how, a, b))
        cols = list(zip(*out)) if out else [()] * 6
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
        ids = batch.column("doc_id").take(pa.array(at, pa.int64()))
        keys = batch.column("key").take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, keys, *arrays], names=["doc_id", "key", "pii_type", "start_pos", "end_pos", "evidence", "a", "b"])


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))


def located(documents: DataFrame) -> DataFrame:
    """(doc_id, key, pii_type, start_pos, end_pos): one row per finding of each row; key is a hash of doc_id and text.

    A text is read twice: once for the given names that headers, titles, mentions and signatures announce
    (a list with a proven bound), once for the findings. Those are written as small rows, and only names with
    nothing but their shape are judged by the collection: a pair of capitalised words that occurs ``FIXED`` times or
    more, mostly as the only pair of its first word, and is announced nowhere, is a term; a given name that
    is met in small letters more often than otherwise is a common word. No text is shuffled.
    """
    spark = documents.sparkSession
    held = spark.sparkContext.broadcast(given_names(documents))
    kind = dict(documents.dtypes)["doc_id"]
    every = cut(_keyed(documents).mapInArrow(lambda it: _rows(it, held), f"doc_id {kind}, {_ROW}"))
    people = every.filter("pii_type = 'person'")
    pairs = people.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("evidence") == "sure").alias("sure"), F.count_if(F.col("evidence") == "small").alias("small"))
    firsts = pairs.groupBy("a").agg(F.sum("n").alias("all"), F.sum("small").alias("small"))
    fixed = pairs.filter((F.col("n") >= FIXED) & (F.col("sure") == 0)).select("a", "b", "n").join(firsts, "a").filter(F.col("n") > 0.5 * F.col("all")).select("a", "b")
    common = firsts.filter(2 * F.col("small") > F.col("all")).select("a")
    spread = F.struct("key", "start_pos")
    shaped = salted_join(people.filter("evidence = 'shape'"), fixed, ["a", "b"], "left_anti", spread)
    small = salted_join(people.filter("evidence = 'small'"), common, ["a"], "left_anti", spread)
    kept = every.filter("evidence = 'sure'").unionByName(shaped).unionByName(small)
    return kept.select("doc_id", "key", "pii_type", "start_pos", "end_pos")


def _redacted(batches):
    for batch in batches:
        texts, lists = batch.column("text").to_pylist(), batch.column("findings").to_pylist()
        clean = pa.array([redact(t, [(f["pii_type"], f["start_pos"], f["end_pos"]) for f in fs or ()]) for t, fs in zip(texts, lists)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), clean, batch.column("findings")], names=["doc_id", "redacted", "findings"])


def redacted(documents: DataFrame) -> DataFrame:
    """(doc_id, redacted, findings) of every document, whole texts.

    findings lists pii_type, start_pos and end_pos (0-based characters). Types: email
    (written plainly or with [at], (at), [dot]), phone, id_number, address (over two lines
    too), person (no titles; names inside an email are not separate). Findings never overlap.
    A null text stays null with no findings; repeated rows stay.
    """
    kind = dict(documents.dtypes)["doc_id"]
    item = "struct<pii_type:string,start_pos:bigint,end_pos:bigint>"
    found = located(documents).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start_pos", "end_pos", "pii_type"))).alias("f"))
    each = _keyed(documents).join(found, "key", "left").select("doc_id", "text", F.coalesce(F.transform("f", lambda x: F.struct(x["pii_type"].alias("pii_type"), x["start_pos"].alias("start_pos"), x["end_pos"].alias("end_pos"))), F.array().cast(f"array<{item}>")).alias("findings"))
    return each.mapInArrow(_redacted, f"doc_id {kind}, redacted string, findings array<{item}>")


def findings(documents: DataFrame) -> DataFrame:
    """(doc_id, pii_type, start_pos): one row per finding."""
    return located(documents).select("doc_id", "pii_type", "start_pos")
