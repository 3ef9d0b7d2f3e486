"""Repair of text from scanned pages: a noisy channel over words, decoded by Viterbi.

The channel's confusion probabilities and the language model are counted over the whole collection.
Nothing that grows with it is held by the driver or broadcast: texts are cut into partitions, each
partition asks for the words, pairs and lines it needs, and the answers are sorted in front of its texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.session import cut, partitions

KINDS = ("hyphen", "misread", "header", "page_no")
BUCKETS = 1 << 22  # bits of the map that tells which words may be misread and which lines may run
SURE = 20  # how much more frequent a word must be than a variant for the variant to tell the channel's noise
PRIOR = 0.1  # occurrences a word never seen elsewhere is given
WEIGHT = 0.6  # of pairs of words against single ones
UNSEEN = 3.0  # a pair never seen is no likelier than so many in all that follow its first word
SLACK = 6.0  # how much more often than expected a word may be misread in one way
DOUBT = 50.0  # a word is doubtful if misreadings explain this share of its occurrences (1 / DOUBT); no context outweighs less
RUNS = 5  # a line must repeat so often to be a running line
ALONE = 0.8  # ... and its rarest pair of words must occur in such lines mostly

# Characters by the strokes a scanner sees; words with equal strokes may be taken for one another.
STROKES = {"0": "c", "o": "c", "1": "l", "i": "l", "|": "l", "5": "s", "9": "g", "2": "z", "8": "ll", "6": "ll", "h": "ll", "b": "ll", "e": "c", "t": "f", "d": "cl", "n": "rl", "u": "rl", "m": "rrl", "w": "vv", "ä": "a", "à": "a", "ö": "c", "ü": "rl", "é": "c", "ﬁ": "fl", "ﬂ": "fl"}
# What is printed and what a scanner may read instead.
CONFUSIONS = [
    ("o", "0"), ("l", "1"), ("i", "1"), ("l", "|"), ("i", "|"), ("s", "5"), ("g", "9"), ("b", "6"), ("b", "8"), ("z", "2"),
    ("i", "l"), ("l", "i"), ("t", "f"), ("f", "t"), ("e", "c"), ("c", "e"), ("o", "c"), ("c", "o"), ("h", "b"), ("b", "h"), ("n", "u"), ("u", "n"),
    ("m", "rn"), ("rn", "m"), ("m", "ni"), ("n", "ri"), ("ri", "n"), ("u", "li"), ("d", "cl"), ("cl", "d"), ("h", "li"), ("li", "h"), ("w", "vv"), ("vv", "w"),
    ("a", "ä"), ("a", "à"), ("o", "ö"), ("u", "ü"), ("e", "é"), ("fi", "ﬁ"), ("fl", "ﬂ"),
]
_SIGNS = {i for i, (_, seen) in enumerate(CONFUSIONS) if not seen.isalpha()}  # no word of any language holds these inside
_FROM: dict[str, list[int]] = {}
for _i, (_true, _seen) in enumerate(CONFUSIONS):
    _FROM.setdefault(_true[0], []).append(_i)

_HYPHENS = "-‐­¬‑"
_WORD = re.compile(r"(?:[^\W_]|(?<=\w)\||\|(?=[^\W_]))+(?:_[^\W_]+)*")
_SIMPLE = re.compile(r"[^\W_]+(?:_[^\W_]+)*")  # the same where no bar stands in the text
_BREAK = re.compile(rf"([^\W\d_][^\W_]*)[{_HYPHENS}]\s*$")
_JOINED = re.compile(rf"[^\W\d_]+[{_HYPHENS}][^\S\n]*\n\s*\S*")  # a word broken over a line end tells nothing
_ENDS = re.compile(rf"[{_HYPHENS}]\s*\n")
_SMALL = re.compile(r"[a-zß-öø-ÿ]{3}")
_COMPOUND = re.compile(r"[^\W\d_]+-[^\W\d_]+")
_HEAD = re.compile(r"\s*([^\W_]*[^\W\d_][^\W_]*)")
_PAGE = re.compile(r"\s*[-–—~\[(|]?\s*(?:(?:p|pg|pp)\.|page|seite)?\s*(?:\d{1,4}(?:\s+(?:of|/)\s+\d{1,4})?|[ivxlc]{1,7})\s*[-–—~\])|]?\s*", re.I)
_TRANS = str.maketrans(STROKES)
_LINE = "\t"  # leads the key of a whole line
_INNER = re.compile(r"[0-9|]")


@lru_cache(maxsize=200_000)
def shape(word: str) -> str:
    """The strokes of a word: all words that look like it have the same."""
    return word.lower().translate(_TRANS)


def _raw(line: str) -> list[str]:
    return _WORD.findall(line) if "|" in line else _SIMPLE.findall(line)


def _words(line: str) -> list[str]:
    return ["#" if w.isdigit() else w for w in _raw(line)]


def line_key(line: str) -> str | None:
    """A line's words by their strokes, numbers and single letters alike; null for a line of less than two words."""
    ws = _raw(line.lower())
    return _keyed(ws) if len(ws) > 1 else None


def _keyed(words: list[str]) -> str:
    return _LINE + " ".join(["#" if len(w) == 1 or w.isdigit() else shape(w) for w in words])


def grams(text: str) -> list[str]:
    """Words, pairs of words (numbers as #), hyphenated words inside lines, and the keys of whole lines of one text."""
    out: list[str] = []
    low = text.lower()
    broken = _ENDS.search(low)
    lines = (_JOINED.sub("\n", low) if broken else low).splitlines()
    for line in lines:
        ws = _words(line)
        out += ws
        out += map(" ".join, zip(ws, ws[1:]))
        if "-" in line:
            out += _COMPOUND.findall(line)
        if not broken and len(ws) > 1 and len(lines) > 1:
            out.append(_keyed(ws))
    if broken:
        out += [k for k in map(line_key, low.splitlines()) if k]
    return out


@lru_cache(maxsize=200_000)
def confused(true: str, seen: str) -> tuple[tuple[int, ...], ...]:
    """The shortest ways (tuples of confusions) to read ``seen`` for ``true``; none if there is no way with three confusions."""
    best: dict[tuple[int, int], list[tuple[int, ...]]] = {(0, 0): [()]}
    found: list[tuple[int, ...]] = []
    for i in range(len(true) + 1):
        for j in sorted(k for a, k in best if a == i):
            ways = best[i, j]
            if i == len(true):
                if j == len(seen):
                    found = ways
                continue
            steps = [(i + 1, j + 1, ())] if seen[j : j + 1] == true[i] else []
            steps += [(i + len(CONFUSIONS[c][0]), j + len(CONFUSIONS[c][1]), (c,)) for c in _FROM.get(true[i], ()) if true.startswith(CONFUSIONS[c][0], i) and seen.startswith(CONFUSIONS[c][1], j)]
            for a, b, c in steps:
                for way in ways:
                    if len(way) + len(c) <= 3:
                        best.setdefault((a, b), []).append((*way, *c))
    least = min(map(len, found), default=0)
    return tuple(dict.fromkeys(w for w in found if len(w) == least)) if least else ()


def noise_counts(cls: list[tuple[str, int]]) -> Counter:
    """Of one class of look-alikes (word, n): (confusion, hits) and (confusion, chances) by frequent words and their rare variants."""
    out: Counter = Counter()
    for true, n in cls:
        if n < SURE or not true.isalpha():
            continue
        for c, (printed, _) in enumerate(CONFUSIONS):
            if k := true.count(printed):
                out[c, 1] += n * k
        for seen, m in cls:
            if m * SURE <= n:
                ways = confused(true, seen)
                if ways and len(ways[0]) == 1:
                    out[ways[0][0], 0] += m
    return out


def confusion_probabilities(counts: dict[tuple[int, int], int]) -> list[float]:
    """The probability of each confusion. Signs inside words (digits, bars) occur in no language, so their rate is the noise of
    the scans; the rate of a letter taken for another, which a rare true word can feign, is held within a twentieth and five times that."""
    hits, chances = (sum(counts.get((c, k), 0) for c in _SIGNS) for k in (0, 1))
    anchor = hits / chances if chances else 0.0
    out = []
    for c in range(len(CONFUSIONS)):
        rate = counts.get((c, 0), 0) / max(counts.get((c, 1), 0), 1)
        out.append(min(max(rate, anchor / 20), 5 * anchor))
    return out


def doubts(cls: list[tuple[str, int]], p: list[float]) -> Iterator[tuple[str, int, float, list[tuple[str, float]]]]:
    """(word, n, n that misreadings do not explain, [(candidate, probability of reading the word for it)]) of words that may be misread."""
    for seen, n in cls:
        cands, expected = [], 0.0
        sign = bool(_INNER.search(seen))
        for true, m in cls:
            if true == seen or m <= n and not sign or not true.replace("_", "").isalpha() or not true.isascii() and seen.isascii():
                continue
            q = sum(math.prod(p[c] for c in way) for way in confused(true, seen))
            if q * m > 0:
                cands.append((true, q))
                expected += q * m
        own = 0.0 if sign else max(n - SLACK * expected, 0.0)
        if cands and DOUBT * expected > own + PRIOR:
            yield seen, n, own, cands


class Model:
    """What a partition of texts knows: n of words and pairs, candidates of doubtful words, running lines."""

    def __init__(self, total: int):
        self.total = max(1, total)
        self.n: dict[str, int] = {}
        self.doubt: dict[str, tuple[float, list[tuple[str, float]]]] = {}
        self.running: set[str] = set()
        self.title: dict[str, str] = {}
        self.leads: set[str] | None = None

    def may_run(self, line: str) -> bool:
        """Whether a running line begins with the same word."""
        if self.leads is None:
            self.leads = {k[1:].split(" ", 1)[0] for k in self.running}
        m = _WORD.search(line)
        return m is not None and ("#" if m.end() - m.start() == 1 or m.group(0).isdigit() else shape(m.group(0))) in self.leads

    @classmethod
    def of(cls, counts: dict[str, int]) -> Model:
        """Of the counts of a whole small collection."""
        m = cls(sum(n for g, n in counts.items() if " " not in g and not g.startswith(_LINE)))
        m.n = {g: n for g, n in counts.items() if not g.startswith(_LINE)}
        looks: dict[str, list[tuple[str, int]]] = {}
        for w, n in m.n.items():
            if " " not in w and "-" not in w and w != "#" and len(w) > 1:
                looks.setdefault(shape(w), []).append((w, n))
        many = [c for c in looks.values() if len(c) > 1]
        noise: Counter = Counter()
        for c in looks.values():
            noise.update(noise_counts(c))
        p = confusion_probabilities(noise)
        m.doubt = {w: (own, cands) for c in many for w, _, own, cands in doubts(c, p)}
        rarest: dict[str, int] = {}
        for g, n in m.n.items():
            if " " in g:
                k = _keyed(g.split(" "))
                rarest[k] = rarest.get(k, 0) + n
        m.running = {g for g, n in counts.items() if g.startswith(_LINE) and n >= RUNS and n >= ALONE * min(rarest.get(_LINE + " ".join(x), 0) for x in zip(g[1:].split(), g[1:].split()[1:]))}
        return m

    def _share(self, w: str) -> float:
        """Probability of a word by itself."""
        if w in self.doubt:
            return (self.doubt[w][0] + PRIOR * (1e-3 if _INNER.search(w) else 1)) / self.total
        return (self.n.get(w, 0) + PRIOR) / self.total

    def _pair(self, a: str, b: str, own: bool) -> float:
        """How often b follows a; without the place in question and what misreadings explain where the words are ``own``."""
        n = self.n.get(f"{a} {b}", 0)
        if own and n:
            n -= 1
            for x, q in self.doubt.get(b, (0, ()))[1]:
                n -= SLACK * q * self.n.get(f"{a} {x}", 0)
            for x, q in self.doubt.get(a, (0, ()))[1]:
                n -= SLACK * q * self.n.get(f"{x} {b}", 0)
        return max(n, 0.0)

    def score(self, a: str | None, b: str, own: bool) -> float:
        """Log probability of b after a. A word that nothing else confirms is not made less likely by what comes before it."""
        single = self._share(b)
        if a is None:
            return math.log(single)
        n, pair = self.n.get(a, 0), self._pair(a, b, own)
        p = WEIGHT * pair / (n + 2) + (1 - WEIGHT) * (single if pair else min(single, UNSEEN / (n + UNSEEN)))
        return math.log(max(p, single) if own and b in self.doubt and self.doubt[b][0] < 1 else p)

    def decode(self, words: list[str]) -> list[str]:
        """The likeliest words behind those seen: Viterbi over each stretch of doubtful words between two certain ones."""
        out = ["#" if w.isdigit() else w for w in words]
        if self.doubt.keys().isdisjoint(out):
            return out
        i = 0
        while i < len(out):
            if out[i] not in self.doubt:
                i += 1
                continue
            j = i
            while j < len(out) and out[j] in self.doubt:
                j += 1
            before = out[i - 1] if i else None
            last = {before: (0.0, ())}
            seen_before = before
            for w in out[i:j]:
                layer = {}
                for c, channel in [(w, 0.0), *((c, math.log(q)) for c, q in self.doubt[w][1])]:
                    layer[c] = max(((s + self.score(a, c, c == w and a == seen_before) + channel, (*path, c)) for a, (s, path) in last.items()), key=lambda x: x[0])
                last, seen_before = layer, w
            if j < len(out):
                last = {c: (s + self.score(c, out[j], c == seen_before), path) for c, (s, path) in last.items()}
            out[i:j] = max(last.values(), key=lambda x: x[0])[1]
            i = j
        return out


def _cased(seen: str, true: str) -> str:
    return true.upper() if seen.isupper() and len(seen) > 1 else true[:1].upper() + true[1:] if seen[:1].isupper() else true


@lru_cache(maxsize=20_000)
def _plain(title: str | None) -> tuple[str, ...]:
    return tuple(shape(w) for w in _WORD.findall(title.lower())) if title else ()


_NUMBERED = re.compile(r"^\s*\d{1,4}\s{2,}|\s{2,}\d{1,4}\s*$")


def is_page_number(line: str) -> bool:
    """A page number alone on its line."""
    return len(line) < 60 and bool(line.strip()) and bool(_PAGE.fullmatch(line))


def is_header(line: str, model: Model, title: str | None = None, section: str | None = None) -> bool:
    """The source's title or the section, with at most two words before or after it; a line that runs through the collection; capitals only."""
    bare = _NUMBERED.sub("", line).strip()
    if not bare:
        return False
    blanks, words = bare.count(" "), None
    for known in (_plain(title), _plain(section)):
        if known and blanks <= 2 * len(known) + 4:  # a word has a blank or two
            words = words or _plain(bare)
            extra = len(words) - len(known)
            if extra <= 2 and any(words[i : i + len(known)] == known for i in range(extra + 1)) and (not extra or len(known) > 1 and not bare.endswith(".")):
                return True
    if model.running and (model.may_run(line) and line_key(line) in model.running or len(bare) < len(line) and model.may_run(bare) and line_key(bare) in model.running):
        return True
    if _SMALL.search(bare):
        return False
    letters = [c for c in bare if c.isalpha()]
    return len(letters) >= 6 and sum(c.isupper() for c in letters) >= 0.9 * len(letters) and len(bare.split()) > 1


def repair(text: str | None, model: Model, title: str | None = None, section: str | None = None, limit: int = 500) -> tuple[str | None, list[str]]:
    """The text as paragraphs without running lines, breaks and misreadings, and the kinds of noise met."""
    if not text or not text.strip():
        return text, []
    kinds: set[str] = set()
    lines = re.split(r"\r?\n", text)
    body: list[str] = []
    for i, line in enumerate(lines):
        cut_off = i == len(lines) - 1 and len(text) >= limit and i and line.strip().isdigit()
        if len(lines) > 1 and not cut_off and is_page_number(line):
            kinds.add("page_no")
        elif len(lines) > 1 and is_header(line, model, title, section):
            kinds.add("header")
            seen = _WORD.findall(line.lower())
            if any(t != "#" and t != w for w, t in zip(seen, model.decode(seen))):
                kinds.add("misread")
        else:
            body.append(line)
    paragraphs, current = [], ""
    for line in body:
        if not line.strip():
            if current:
                paragraphs.append(current)
            current = ""
            continue
        b, h = (_BREAK.search(current), _HEAD.match(line)) if current and current[-1] in _HYPHENS else (None, None)
        if b and h:
            first, second = b.group(1).lower(), h.group(1).lower()
            known = model.n.get(first + second, 0) > 0
            parts = model.n.get(first, 0) > 0 and model.n.get(second, 0) > 0 and len(first) > 2 and len(second) > 2
            compound = model.n.get(f"{first}-{second}", 0) > 0 or (not known and parts)
            if current[b.end(1)] != "-" or known or not compound:
                kinds.add("hyphen")
                current = current[: b.end(1)] + line.lstrip()
            else:
                current = current[: b.end(1)] + "-" + line.lstrip()
        else:
            current = f"{current.rstrip()} {line.strip()}" if current else line.strip()
        current = current.rstrip()
    if current:
        paragraphs.append(current)
    out = []
    for p in paragraphs:
        seen = _raw(p.lower()) if len(p.lower()) == len(p) else [w.lower() for w in _WORD.findall(p)]
        if model.doubt.keys().isdisjoint(seen):
            out.append(p)
            continue
        at, built = 0, []
        for m, w, t in zip(_WORD.finditer(p), seen, model.decode(seen)):
            if t != "#" and t != w:
                kinds.add("misread")
                built += [p[at : m.start()], _cased(m.group(0), t)]
                at = m.end()
        out.append("".join([*built, p[at:]]))
    return "\n\n".join(out), [k for k in KINDS if k in kinds]


def _bucket(key: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(key) & (BUCKETS - 1)


def _counted(batches):
    total: Counter = Counter()
    for batch in batches:
        for t in batch.column("text_preview").to_pylist():
            total.update(grams(t))
            if len(total) > 400_000:
                yield _gram_rows(total)
                total.clear()
    yield _gram_rows(total)


def _gram_rows(c):
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["gram", "n"])


def _classes(batches) -> Iterator[list[tuple[str, int]]]:
    """Words of one shape, from rows sorted by it."""
    at, cls = None, []
    for batch in batches:
        for s, w, n in zip(*(batch.column(c).to_pylist() for c in ("shape", "gram", "n"))):
            if s != at:
                if cls:
                    yield cls
                at, cls = s, []
            cls.append((w, n))
    if cls:
        yield cls


def _shaped(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([shape(w) for w in batch.column("gram").to_pylist()], pa.string()), batch.column("gram"), batch.column("n")], names=["shape", "gram", "n"])


def _noise(batches):
    total: Counter = Counter()
    for cls in _classes(batches):
        total.update(noise_counts(cls))
    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in total], pa.int32()), pa.array([k for _, k in total], pa.int32()), pa.array(list(total.values()), pa.int64())], names=["confusion", "kind", "n"])


def _doubtful(batches, p):
    rows = []
    for cls in _classes(batches):
        if len(cls) > 1:
            rows += doubts(cls, p)
        if len(rows) > 20_000:
            yield _doubt_rows(rows)
            rows = []
    yield _doubt_rows(rows)


_CANDS = pa.list_(pa.struct([("c", pa.string()), ("q", pa.float64())]))


def _doubt_rows(rows):
    cands = pa.array([[{"c": c, "q": q} for c, q in r[3]] for r in rows], _CANDS)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()), cands, pa.array([_bucket(r[0]) for r in rows], pa.int32())], names=["word", "own", "cands", "bucket"])


def _lead(key: str) -> str:
    """The key of all lines that begin like this one."""
    return key.split(" ", 1)[0] + _LINE


def _line_pairs(batches):
    """The pairs of words of each line key; and, of pairs, their key by strokes."""
    for batch in batches:
        rows = [(g, _LINE + f"{a} {b}", _bucket(g), _bucket(_lead(g))) for g in batch.column("gram").to_pylist() for a, b in zip(g[1:].split(" "), g[1:].split(" ")[1:])]
        cols = list(zip(*rows)) if rows else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["line", "pair", "bucket", "lead"])


def _pair_keys(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_keyed(g.split(" ")) for g in batch.column("gram").to_pylist()], pa.string()), batch.column("n")], names=["pair", "n"])


def _asked(batches, held):
    """(part, kind, a, b) a text needs: pairs with a word that may be doubtful, words at broken line ends, lines that may run."""
    bits = held.value
    maybe: dict[str, bool] = {}

    def may(w: str) -> bool:
        hit = maybe.get(w)
        if hit is None:
            if len(maybe) > 1_000_000:
                maybe.clear()
            hit = maybe[w] = bool(bits[_bucket(w)])
        return hit

    for batch in batches:
        asked: dict[int, set] = {}
        for part, text, source in zip(*(batch.column(c).to_pylist() for c in ("part", "text_preview", "source_id"))):
            want = asked.setdefault(part, set())
            if source is not None:
                want.add(("t", source, ""))
            if not text:
                continue
            lines = text.splitlines()
            words = [_words(line) for line in text.lower().splitlines()]
            for i, line in enumerate(lines):
                ws = words[i]
                if any(map(may, ws)):
                    for a, b in zip(ws, ws[1:]):
                        if may(a) or may(b):
                            want.add(("p", a, b))
                    if len(ws) == 1:
                        want.add(("p", ws[0], ws[0]))
                for k in range(i + 1, min(i + 4, len(lines))):  # running lines may stand between
                    if ws and words[k] and (may(ws[-1]) or may(words[k][0])):
                        want.add(("p", ws[-1], words[k][0]))
                end = line.rstrip()
                b = _BREAK.search(end) if end and end[-1] in _HYPHENS else None
                if b:
                    for k in range(i + 1, min(i + 4, len(lines))):
                        h = _HEAD.match(lines[k])
                        if h:
                            first, second = b.group(1).lower(), h.group(1).lower()
                            whole = first + second
                            want.update((("w", x, "") for x in (whole, first, second, f"{first}-{second}")))
                            if may(whole):
                                want.add(("p", ws[-2] if len(ws) > 1 else whole, whole))
                                want.add(("p", whole, words[k][1] if len(words[k]) > 1 else whole))
                if len(lines) > 1 and ws:
                    for part_of in (ws, ws[1:] if ws[0] == "#" else ws[:-1] if ws[-1] == "#" else ()):  # with its page number and without
                        if len(part_of) > 1 and may(_LINE + ("#" if len(part_of[0]) == 1 else shape(part_of[0])) + _LINE):
                            key = _keyed(part_of)
                            if bits[_bucket(key)]:
                                want.add(("l", key, ""))
        rows = [(p, *w) for p, ws in asked.items() for w in ws]
        cols = list(zip(*rows)) if rows else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.string()) for c in cols[1:])], names=["part", "kind", "a", "b"])


def _repaired(batches, total):
    """Rows sorted by part and role: what the part asked for, then its texts; equal texts follow one another."""
    model, at, last = Model(total), None, None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("part", "role", "kind", "key", "n", "own", "cands", "chunk_id", "source_id", "section_title", "text_preview")]
        out = []
        for part, role, kind, key, n, own, cands, chunk, source, section, text in zip(*cols):
            if part != at:
                model, at, last = Model(total), part, None
            if role == 0:
                if kind == "d":
                    model.doubt[key] = (own, [(c["c"], c["q"]) for c in cands])
                elif kind == "l":
                    model.running.add(key)
                elif kind == "t":
                    model.title[key] = cands[0]["c"]
                else:
                    model.n[key] = n
            elif (chunk, source, section, text) != last:
                last = (chunk, source, section, text)
                out.append((chunk, source, *repair(text, model, model.title.get(source), section)))
        cols = list(zip(*out)) if out else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.string()))], names=["chunk_id", "source_id", "repaired", "kinds"])


def repaired(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """(chunk_id, source_id, repaired, kinds) of each distinct row of chunks.

    One pass counts words, pairs and whole lines of all texts. Words with equal strokes form classes; the
    rare variants of frequent words in them give the probability of each confusion of characters, and the
    words that such confusions can explain are doubtful, with their candidates. A line that repeats, while its
    rarest pair of words hardly occurs outside such lines, runs. A bit map of fixed size tells a second
    pass which words and lines to ask about; counts and candidates are joined to these requests and
    sent to the texts' partitions, so texts are shuffled once and no part of the model is collected. Per text, page
    numbers and running lines go, broken words are joined where the joined word is known or
    the sign is no plain hyphen, and each stretch of doubtful words is decoded by Viterbi with the
    probabilities of confusions and pairs. A word that only fits its place is kept: a rewriting needs more
    evidence than the word itself has. Null and empty texts stay as they are, with no kinds; a null source has no title.
    """
    spark = chunks.sparkSession
    width = partitions(spark)
    columns = ["chunk_id", "source_id", "section_title", "text_preview"]
    texts = chunks.select("text_preview").filter("text_preview is not null")
    counts = cut(texts.mapInArrow(_counted, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")))
    is_line, is_pair = F.col("gram").startswith(_LINE), F.col("gram").contains(" ")
    words = counts.filter(~is_line & ~is_pair)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    plain = words.filter(~F.col("gram").contains("-") & (F.length("gram") > 1))
    classes = plain.mapInArrow(_shaped, "shape string, gram string, n bigint").repartition("shape").sortWithinPartitions("shape", F.desc("n"), "gram")
    noise = classes.mapInArrow(_noise, "confusion int, kind int, n bigint").groupBy("confusion", "kind").agg(F.sum("n").alias("n")).collect()  # two rows a confusion
    p = confusion_probabilities({(r.confusion, r.kind): r.n for r in noise})
    doubt = cut(classes.mapInArrow(lambda it: _doubtful(it, p), "word string, own double, cands array<struct<c:string,q:double>>, bucket int"))
    lines = counts.filter(is_line & (F.col("n") >= RUNS))
    pairs = counts.filter(~is_line & is_pair).mapInArrow(_pair_keys, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("m"))
    rarest = lines.select("gram").mapInArrow(_line_pairs, "line string, pair string, bucket int, lead int").join(pairs, "pair", "left").groupBy("line", "bucket", "lead").agg(F.min(F.coalesce("m", F.lit(0))).alias("m"))
    running = cut(rarest.join(lines.select(F.col("gram").alias("line"), "n"), "line").filter(F.col("n") >= ALONE * F.col("m")).select("line", "bucket", "lead"))
    at = doubt.select("bucket").unionByName(running.select(F.explode(F.array("bucket", "lead")).alias("bucket"))).distinct().toArrow()["bucket"].to_numpy()  # at most BUCKETS numbers
    bits = np.zeros(BUCKETS, dtype=bool)
    bits[at] = True
    held = spark.sparkContext.broadcast(bits)

    rows = chunks.select(*columns).withColumn("part", F.pmod(F.xxhash64(*columns), F.lit(width)).cast("int"))
    asked = cut(rows.select("part", "text_preview", "source_id").mapInArrow(lambda it: _asked(it, held), "part int, kind string, a string, b string").distinct())
    cand = doubt.select("word", F.explode("cands.c").alias("c")).unionByName(doubt.select("word", F.col("word").alias("c")))
    near = asked.filter("kind = 'p'").select("part", "a", "b")
    ca, cb = cand.select(F.col("word").alias("a"), F.col("c").alias("x")), cand.select(F.col("word").alias("b"), F.col("c").alias("y"))
    wide = near.join(ca, "a", "left").join(cb, "b", "left").select("part", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    keys = wide.select("part", F.explode(F.array(F.concat_ws(" ", "x", "y"), "x", "y")).alias("gram")).unionByName(asked.filter("kind = 'w'").select("part", F.col("a").alias("gram"))).distinct()
    none = F.lit(None)
    shape_of = lambda df, kind, key, n=none, own=none, cands=none: df.select("part", F.lit(kind).alias("kind"), F.col(key).alias("key"), n.cast("bigint").alias("n"), own.cast("double").alias("own"), cands.cast("array<struct<c:string,q:double>>").alias("cands"))
    known = shape_of(keys.join(counts, "gram"), "n", "gram", n=F.col("n"))
    met = near.select("part", F.explode(F.array("a", "b")).alias("word")).unionByName(asked.filter("kind = 'w'").select("part", F.col("a").alias("word"))).distinct()
    doubted = shape_of(met.join(doubt, "word"), "d", "word", own=F.col("own"), cands=F.col("cands"))
    runs = shape_of(asked.filter("kind = 'l'").select("part", F.col("a").alias("line")).join(running, "line"), "l", "line")
    titles = sources.filter("source_id is not null").groupBy(F.col("source_id").alias("a")).agg(F.max("title").alias("title")).filter("title is not null")
    titled = shape_of(asked.filter("kind = 't'").select("part", "a").join(titles, "a"), "t", "a", cands=F.array(F.struct(F.col("title").alias("c"), F.lit(0.0).alias("q"))))
    empty = [F.lit(None).cast("string").alias(c) for c in columns]
    facts = known.unionByName(doubted).unionByName(runs).unionByName(titled).select("part", F.lit(0).alias("role"), "kind", "key", "n", "own", "cands", *empty)
    body = rows.select("part", F.lit(1).alias("role"), none.cast("string").alias("kind"), none.cast("string").alias("key"), none.cast("bigint").alias("n"), none.cast("double").alias("own"), none.cast("array<struct<c:string,q:double>>").alias("cands"), *columns)
    met = facts.unionByName(body).repartitionById(width, F.col("part")).sortWithinPartitions("part", "role", *columns)
    return met.mapInArrow(lambda it: _repaired(it, total), "chunk_id string, source_id string, repaired string, kinds array<string>")


def noise(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """(chunk_id, noise_kind): the kinds met in any row of a chunk."""
    return repaired(chunks, sources).select("chunk_id", F.explode("kinds").alias("noise_kind")).distinct()
