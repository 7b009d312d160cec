"""Sentence, headline and advert units of scanned pages, whatever the language.

Two passes over all texts. The first counts words (per language label) as they occur: capitalised or
not, with or without a full stop or other terminator, after a comma and closing quotation mark. Words
that occur at least once in ``1 / rarest`` of all words form the corpus lexicon, which therefore has at
most ``rarest`` entries, and is broadcast.

The second reads each page. Line boxes give its columns, headline lines (taller) and advert lines
(indented); without boxes the text alone does. Lines of one article, put in reading order, form a
stream; headlines and adverts are streams of their own. In a stream every place where a unit may begin is
decided by document-centred evidence with the corpus as fallback: a capitalised word that the page has
more often in lower case than capitalised within sentences is an ordinary word and begins a unit, with or
without a mark before it; one that it has capitalised there is a name, which begins one only after a
terminator; a word that it writes with a stop before commas and lower case, and never without, is an
abbreviation, whose stop is no terminator, and one it writes mostly without is none. Where the page is
silent or its evidence is even, the corpus decides: frequent words in lower case are ordinary, words
(nearly) always with a full stop are abbreviations. Scripts without
capitals use their own terminators, scripts without terminators their spaces.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipple.llm.common import cut

_UPPER = "".join(chr(c) for c in range(0x41, 0x590) if chr(c).isupper())
_LOWER = "".join(chr(c) for c in range(0x61, 0x590) if chr(c).islower())
_UP, _LOW = re.escape(_UPPER), re.escape(_LOWER)
_OPEN = "“„«‘‚‹「『\"'(\\[¿¡—–―★☆◆◇●■□▪•☞☛►▶※§†‡*"
_ORNAMENTS = "★☆◆◇●■□▪•☞☛►▶※—–―*"
_CLOSE = "”“»’›」』\"')\\]"
_MARKS = ".!?…。！？｡．।॥؟۔;·։"

_LINE = re.compile(r"[^\n\r\x0b\x0c\x85  ]+")
_GAP = re.compile(r" \| |\t+| {3,}")
_WORD = re.compile(r"[^\s.,!?;:…。、，「」『』«»“”„‘’\"'()|।؟،؛·]+[.!?।؟|;]?")
_REPORT = re.compile(r"[,،、，]\s?[”»“\"」]\s*([^\s.,…،。、」]+)")
# A place where a unit of a cased script may begin: openers, then a capital, digit or currency sign;
# at the start of a line or after a blank, or (lost blank) right after a mark or closing quotation mark.
_START = re.compile(rf"(?:(?<=\s)|^|(?<=[{_LOW}][.!?])|(?<=[{_LOW}][.!?][”»]))([{_OPEN}]*\s?[{_OPEN}]*)([$£€]?[0-9][^\s]*|[{_UP}][^\s.,!?;:”“»«\"]*)", re.M)
_TAIL = re.compile(rf"([{re.escape(_MARKS)}]+)\s*[{_CLOSE}\s]*$")
_TAILS = set(_MARKS) | set("”»“’›」』\"')]")
_NAMED = re.compile(r"\s*[^\W\d_]+:")
_CLOSER_TAIL = re.compile(rf"[{_CLOSE}]\s*$")
_ELLIPSIS = re.compile(r"(?:…|\.\s?\.\s?\.)$")
_DOTS = re.compile(rf"(?:[^\W\d_]{{1,2}}\.){{2,}}$")
_CORE = re.compile(rf"^[^\w]*([^\W\d_]+)")
_LASTWORD = re.compile(r"([^\s“„«‘\"'(\[「]+?)\.$")
_REPORTED = re.compile(rf"[{_CLOSE}]\s*[{_LOW}]+$")
_LOW_RUN = re.compile(rf"[{_LOW}]{{4}}")
_HYPHEN = "-‐‑¬=\xad⸗"
_SPANS = {"cjk": [(0x3040, 0x30FF), (0x3400, 0x9FFF)], "thai": [(0x0E00, 0x0E7F)], "deva": [(0x0900, 0x097F)], "arab": [(0x0600, 0x06FF)]}
# Scripts without capitals that end sentences with a mark of their own or with the common ones: Hebrew, Syriac,
# Thaana and N'Ko; the other scripts of India and Ceylon; Lao, Tibetan and Burmese; Georgian; Hangul;
# Ethiopic; Khmer and Mongolian; Georgian again; Hangul again.
_SPANS["space"] = [(0x0590, 0x05FF), (0x0700, 0x07FF), (0x0980, 0x0DFF), (0x0E80, 0x109F), (0x10A0, 0x11FF), (0x1200, 0x139F), (0x1780, 0x18AF), (0x1C90, 0x1CBF), (0x3130, 0x318F), (0xAC00, 0xD7AF)]
_THAI = re.compile(r"[\u0e00-\u0e7f]")


class Lexicon:
    """Corpus evidence by language and word."""

    def __init__(self, rows: list[tuple[str, str, int, int, int, int]]):
        self.common: dict[str, set[str]] = defaultdict(set)
        self.abbreviation: set[str] = set()
        self.reporter: set[str] = set()
        self.closing: set[str] = set()
        self.low: dict[str, Counter] = defaultdict(Counter)
        for lang, word, n, dotted, ended, reported in rows:
            lower = word.lower()
            if word == lower:
                self.low[lang][lower] += n
            if dotted >= 0.8 * n and n >= 5:
                self.abbreviation.add(lower)
            if reported >= 3 and reported >= 0.2 * n:
                self.reporter.add(lower)
            if ended + dotted >= 0.9 * n and n >= 20:
                self.closing.add(lower)
        capital: dict[str, Counter] = defaultdict(Counter)
        total: Counter = Counter()
        for lang, word, n, *_ in rows:
            total[lang] += n
            if word != word.lower():
                capital[lang][word.lower()] += n
        # Ordinary words are both mostly not capitalised and frequent; a rare word in lower case may be a name too.
        for lang, counts in self.low.items():
            self.common[lang] = {w for w, n in counts.items() if n >= 0.2 * (n + capital[lang][w]) and n >= 0.0008 * total[lang]}
        #: The most frequent words tell a page's language, however it is labelled.
        self.tell = {lang: {w for w, _ in c.most_common(150)} for lang, c in self.low.items() if lang}

    def language(self, label: str | None, words: set[str]) -> str:
        best, most = label or "", 0
        for lang, tell in self.tell.items():
            n = len(words & tell)
            if n > most or (n == most and lang == label):
                best, most = lang, n
        return best


def word_counts(df: DataFrame, text_col: str, lang_col: str | None, rarest: int = 100_000) -> DataFrame:
    """``(lang, word, n, dotted, ended, reported)`` of every word at least ``1 / rarest`` of all words.

    Each text's words are counted in the task that reads it; a language's counts are added up by word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, Counter] = defaultdict(Counter)
            reported: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    by_lang[lang or ""].update(_WORD.findall(text))
                    reported[lang or ""].update(_REPORT.findall(text))
            out = []
            for lang, counts in by_lang.items():
                words: dict[str, list[int]] = {}
                for token, n in counts.items():
                    mark = token[-1]
                    bare = token[:-1] if mark in ".!?।؟|;" else token
                    if not bare or len(bare) > 40 or bare[0].isdigit():
                        continue
                    w = words.setdefault(bare, [0, 0, 0, 0])
                    w[0] += n
                    w[1] += n * (mark == ".")
                    w[2] += n * (mark in "!?।؟|;")
                for word, n in reported[lang].items():
                    if word in words:
                        words[word][3] += n
                out += [(lang, w, *v) for w, v in words.items()]
            names = ["lang", "word", "n", "dotted", "ended", "reported"]
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 2 else pa.int64()) for i, c in enumerate(cols)], names=names)

    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    words = df.select(F.col(text_col).alias("text"), lang.alias("lang")).mapInArrow(run, "lang string, word string, n long, dotted long, ended long, reported long")
    words = cut(words.groupBy("lang", "word").agg(*[F.sum(c).alias(c) for c in ("n", "dotted", "ended", "reported")]))
    part = words.groupBy(F.pmod(F.xxhash64("word"), F.lit(64)).alias("p")).agg(F.sum("n").alias("n"))
    total = part.agg(F.sum("n").alias("total"))
    return words.crossJoin(F.broadcast(total)).filter(F.col("n") * rarest >= F.col("total")).drop("total")


class Page:
    """Evidence of one page about its own words; looked up where a word is in doubt, each word once."""

    def __init__(self, text: str, german: bool = False):
        self.text, self.german = text, german
        self._words: dict[str, tuple[int, list[int]]] = {}
        self._stops: dict[str, bool | None] = {}

    def _places(self, word: str) -> Iterator[int]:
        text, at, n = self.text, self.text.find(word), len(word)
        while at >= 0:
            if not (at and text[at - 1].isalnum()) and not text[at + n : at + n + 1].isalnum():
                yield at
            at = text.find(word, at + n)

    def _inside(self, at: int, lexicon: Lexicon) -> bool:
        """Whether what stands before a place shows it to be within a sentence: a word, a comma or an abbreviation."""
        before = self.text[max(0, at - 24) : at]
        bare = before.rstrip(" ")
        if bare == before or not bare:
            return False
        if bare[-1] == ".":
            title = bare[:-1].rsplit(None, 1)[-1] if len(bare) > 1 else ""
            return bool(title) and title[0].isupper() and title.isalpha() and (len(title) == 1 or title.lower() in lexicon.abbreviation)
        return bare[-1] == "," or bare[-1].islower()

    def ordinary(self, word: str, at: int, lexicon: Lexicon) -> bool | None:
        """Whether a capitalised word, in doubt at ``at``, is an ordinary word here; None if the page does not tell.

        Lower case elsewhere speaks for it, capitals at other places within sentences against it.
        """
        if word not in self._words:
            low = sum(1 for _ in self._places(word.lower()))
            self._words[word] = (low, [p for p in self._places(word) if self._inside(p, lexicon)])
        low, capitals = self._words[word]
        others = sum(p != at for p in capitals)
        if others > low:
            return False
        # One lower-case occurrence may be misread or a name's namesake: the page tells by more of them than of capitals.
        return True if low >= 2 and low > (2 if self.german else 1) * len(capitals) else None

    def abbreviation(self, word: str) -> bool | None:
        """Whether the page writes a word with a stop that ends nothing; None if the page does not tell."""
        if word not in self._stops:
            plain = dotted = inner = 0
            for at in self._places(word):
                rest = self.text[at + len(word) : at + len(word) + 4]
                if rest[:1] == ".":
                    dotted += 1
                    after = rest[1:].lstrip(" ")
                    inner += after[:1] in (",", ";", ":") if after else False
                    inner += rest[1:2] == " " and after[:1].islower()
                elif rest[:1].isspace() or not rest:
                    plain += 1
            told = None
            if plain >= 2 and plain >= dotted:
                told = False
            elif not plain and inner and (inner >= 2 or dotted >= 3):
                told = True
            self._stops[word] = told
        return self._stops[word]


class Line:
    __slots__ = ("begin", "end", "x0", "x1", "y0", "height", "side")

    def __init__(self, begin: int, end: int, box: tuple[int, int, int, int] | None, side: int):
        self.begin, self.end, self.side = begin, end, side
        self.x0, self.x1, self.y0, self.height = (box[0], box[2], box[1], box[3] - box[1]) if box else (0, 0, 0, 0)


def page_lines(text: str, boxes: np.ndarray | None) -> tuple[list[Line], bool]:
    """The page's lines, with lines of two columns that were run together cut in two; whether boxes hold."""
    spans = [m.span() for m in _LINE.finditer(text) if not m.group().isspace()]
    known = boxes is not None and len(boxes) == len(spans)
    corners = boxes.tolist() if known else []
    gaps = [_GAP.search(text, a, b) for a, b in spans] if " | " in text or "\t" in text or "   " in text else [None] * len(spans)
    joined = sum(g is not None for g in gaps)
    split = joined >= 2 and joined >= 0.4 * len(spans)
    lines = []
    for i, ((a, b), g) in enumerate(zip(spans, gaps, strict=True)):
        box = corners[i] if known else None
        if split and g is not None and g.start() > a and g.end() < b:
            lines += [Line(a, g.start(), box, 0), Line(g.end(), b, box, 1)]
        else:
            lines.append(Line(a, b, box, 0))
    if split and known:
        # What is left of the right-hand column alone stands far to the right: it goes on with that column.
        left = min(v.x0 for v in lines)
        for v in lines:
            if not v.side and v.x0 - left > 100:
                v.side, v.x0 = 1, left
    return lines, known


def _capitals(s: str) -> bool:
    if _LOW_RUN.search(s):
        return False
    letters = [c for c in s if c.isalpha()]
    return len(letters) > 3 and sum(c.isupper() for c in letters) >= 0.9 * len(letters)


def streams(text: str, lines: list[Line], known: bool, common: set[str], right_to_left: bool = False) -> list[tuple[str, list[Line]]]:
    """The page's streams in reading order: headlines, articles and adverts, each a list of lines.

    Columns are read from the left whatever the script (so the pages at hand run on, Arabic ones too)
    unless told otherwise.
    """
    if not lines:
        return []
    if not known:
        return _plain_streams(text, lines, common)
    body = min(x.height for x in lines)
    tall = body * 1.25 if len(lines) > 1 else 1e9
    columns: list[list[Line]] = []
    for line in sorted(lines, key=lambda v: (v.side, v.x0)):
        if columns and columns[-1][0].side == line.side and line.x0 - columns[-1][-1].x0 <= 100:
            columns[-1].append(line)
        else:
            columns.append([line])
    if right_to_left:
        columns.sort(key=lambda c: (c[0].side, -c[0].x0))
    head: list[Line] = []
    article: list[Line] = []
    adverts: list[list[Line]] = []
    for column in columns:
        column.sort(key=lambda v: (v.y0, v.begin))
        xs = sorted(v.x0 for v in column)
        base = xs[int(0.3 * (len(xs) - 1))]
        advert: list[Line] = []
        for line in column:
            if line.height >= tall and line.side == 0 and (not article or head):
                head.append(line)
                continue
            if line.side == 0 and line.x0 - base >= 12:
                advert.append(line)
                continue
            if advert:
                adverts.append(advert)
                advert = []
            article.append(line)
        if advert:
            adverts.append(advert)
    article, more = _lift_adverts(text, article)
    out = [("headline", head)] if head else []
    out += [("article", article)] if article else []
    return out + [("advert", a) for a in adverts + more]


_ORNAMENT = re.compile(r"^\s*(?:[★☆◆◇●■▪•☞☛►▶※—–―]|\*{2,})")


def _plain_streams(text: str, lines: list[Line], common: set[str]) -> list[tuple[str, list[Line]]]:
    """Without boxes: a headline is what stands first in capitals, or in lower case before a capitalised line."""
    lines = sorted(lines, key=lambda v: v.side)
    n = 0
    while n < min(len(lines), 4) and _capitals(text[lines[n].begin : lines[n].end]) and not _ORNAMENT.match(text[lines[n].begin : lines[n].end]):
        n += 1
    if not n and len(lines) > 1:
        first = text[lines[0].begin : lines[0].end].lstrip()
        if first[:1].islower():
            for i in (1, 2):
                if i < len(lines):
                    m = _CORE.match(text[lines[i].begin : lines[i].end])
                    if m and m.group(1)[:1].isupper() and m.group(1).lower() in common:
                        n = i
                        break
    article, adverts = _lift_adverts(text, lines[n:])
    return ([("headline", lines[:n])] if n else []) + ([("article", article)] if article else []) + [("advert", a) for a in adverts]


def _lift_adverts(text: str, lines: list[Line]) -> tuple[list[Line], list[list[Line]]]:
    """Takes out runs of lines that begin with an ornament and are set in capitals."""
    kept: list[Line] = []
    adverts: list[list[Line]] = []
    inside = False
    for line in lines:
        part = text[line.begin : line.end]
        if _ORNAMENT.match(part) and (_capitals(part) or part.lstrip().startswith("***")):
            adverts.append([line])
            inside = _capitals(part)
        elif inside and _capitals(part):
            adverts[-1].append(line)
        else:
            inside = False
            kept.append(line)
    return kept, adverts


def _abbreviated(tail: str, lexicon: Lexicon, page: Page) -> bool:
    """Whether the last word before the marks is an abbreviation with its stop: by the page, else by the corpus."""
    m = _LASTWORD.search(tail)
    if not m:
        return False
    word = m.group(1)
    if _DOTS.search(word + "."):
        return True
    word = word.rsplit(".", 1)[-1].lstrip("([“„«\"'")
    if not word:
        return False
    if m.group(1).isdigit():
        return len(word) <= 2
    if word.isdigit():
        return False
    if len(word) == 1:
        return word.isalpha()
    told = page.abbreviation(word)
    return word.lower() in lexicon.abbreviation if told is None else told


def cased_starts(text: str, lines: list[Line], common: set[str], lexicon: Lexicon, page: Page, german: bool, capitals: bool) -> list[int]:
    """Starts of the units of a stream in a script with capitals; its first character is one."""
    begin = lines[0].begin
    out = [begin + len(text[begin : lines[0].end]) - len(text[begin : lines[0].end].lstrip())]
    before = ""
    for k, line in enumerate(lines):
        part = text[line.begin : line.end]
        shouting = capitals or _capitals(part)
        for m in _START.finditer(part):
            at, lead, token = m.start(), m.group(1), m.group(2)
            while lead and lead[0] in "“\"'‘" and at and not part[at - 1].isspace():
                at, lead = at + 1, lead[1:]  # a closing mark of the word before
            opener = lead.strip()
            prev = part[:at].rstrip()
            if not prev:
                prev = before
            if not prev:
                continue
            prev = prev[-40:]
            last = prev[-1]
            if last in _HYPHEN and at == len(part) - len(part.lstrip()):
                continue
            tail = _TAIL.search(prev) if last in _TAILS else None
            marks = tail.group(1) if tail else ""
            stem = prev[: tail.end(1)] if tail else prev
            if marks == "·" and last == "·" and not token[0].isupper():
                marks = ""
            if marks == ";" and not any("Ͱ" <= c <= "Ͽ" for c in prev):
                marks = ""
            core = _CORE.match(token if token.isascii() else unicodedata.normalize("NFKC", token))
            word = core.group(1) if core else ""
            digit = not word or not token[0].isalpha()
            lower = word.lower()
            initial = len(word) == 1 and part[m.end() : m.end() + 1] == "."
            dotted = bool(marks) and not marks.strip(".") and len(marks) == 1 and _abbreviated(stem, lexicon, page)
            ellipsis = bool(marks) and bool(_ELLIPSIS.search(stem)) and not re.search(r"(?:…|\.\s?\.\s?\.)\s?\.$", stem)
            ends = bool(marks) and not dotted and not ellipsis
            known = False
            if not ends and not digit and not shouting and not initial and not _DOTS.match(part[m.start(2) : m.start(2) + 12].split()[0]):
                told = page.ordinary(word, line.begin + m.start(2), lexicon)
                # After an abbreviation's stop or a reporting verb a name is due, though it may have a namesake among the page's words.
                due = told and (dotted or _REPORTED.search(prev))
                known = lower in common if told is None or due else told
            if ends:
                ok = True
                if digit and not opener and marks in (".", "·") and re.search(r"\d\.$", stem) and not re.search(r"\d[.,]\d+\.$", stem):
                    ok = False
            elif shouting:
                ok = False
            elif digit:
                ok = False
            elif marks:
                ok = known and not (dotted and re.search(r"\d\.$", stem) and german)
            elif opener and opener[-1] in "“„«\"‘「" and last not in ":,،、":
                ok = known or word[1:].islower()
                if last == "(":
                    ok = False
            elif last in ":":
                ok = False
            elif last == "," or last in _TAILS and _CLOSER_TAIL.search(prev):
                ok = known and not re.search(r",\s*[”»“\"]$", prev)
            else:
                ok = known
                if not ok and k + 1 and _NAMED.match(part, m.end()):
                    ok = True
            if opener.startswith("(") and not (marks and not dotted and not ellipsis):
                ok = False
            if opener and last == ":" and opener[0] not in _ORNAMENTS:
                ok = False
            if opener and opener[0] in _ORNAMENTS and at == len(part) - len(part.lstrip()):
                ok = True
            if ok:
                out.append(line.begin + at + len(lead) - len(lead.lstrip()))
        before = part.rstrip() or before
    return out


_CJK_TERMS = re.compile(r"[。！？!?｡]+[」』”\"）)]*|(?<![0-9.])[.．](?![0-9.])[」』]*|(?<=[぀-鿿])['·‘’](?=[぀-鿿])")
# Marks of one script only end a sentence whether or not a blank follows.
_SPACE_TERMS = re.compile(r"[.!?।॥؟۔|…։។៕။།༎።፧፨᠃]+\s*[”»“\"')\]]*(?:\s+|$)|[។៕။།༎።፧፨᠃]+[”»“\"')\]]*")
_JA_REPORT = re.compile(r"[^。！？、「」\s]{1,12}と[^。！？、「」\s]{1,6}た|[^。！？、「」\s]{1,8}[說説问問答道]")


def _joined(text: str, lines: list[Line], gap: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The stream as one string, and where each line begins in it and in the text."""
    parts = [text[v.begin : v.end] for v in lines]
    ends = np.cumsum([len(p) + len(gap) for p in parts])
    return gap.join(parts), np.append(0, ends[:-1]), np.array([v.begin for v in lines])


def uncased_starts(text: str, lines: list[Line], script: str, lexicon: Lexicon, page: Page) -> list[int]:
    """Starts of the units of a stream in a script without capitals."""
    s, at, origin = _joined(text, lines, "" if script == "cjk" else "\n")
    starts = [len(s) - len(s.lstrip())] if s.strip() else []
    if script == "cjk":
        for m in _CJK_TERMS.finditer(s):
            e = m.end()
            while e < len(s) and s[e].isspace():
                e += 1
            rest = s[e : e + 30]
            if not rest or rest[0] in "、，,。」』」)":
                continue
            quoted = m.group()[-1] in "」』”\""
            if quoted and _JA_REPORT.match(rest.replace("\n", "")):
                continue
            starts.append(e)
    elif script == "thai":
        for m in re.finditer(r"([^\s]+)( +|\n| )", s):
            e = m.end()
            rest = s[e : e + 1]
            word = m.group(1)
            if not rest or rest in "\n ":
                continue
            if re.search(r"[.!?…]+[”»\"')]*$", word) and not re.search(r"(?:\.\.|…)$|[฀-๿]{1,3}\.$", word):
                starts.append(e)
            elif m.group(2) != "\n" and _THAI.match(word[-1]) and (_THAI.match(rest) or rest in "“"):
                prior = s[: m.start()].rstrip()
                if not (prior and prior[-1].isdigit()):
                    starts.append(e)
    else:
        for m in _SPACE_TERMS.finditer(s):
            e = m.end()
            rest = s[e : e + 40]
            if not rest.strip():
                continue
            marks = m.group().strip().rstrip("”»“\"')]").rstrip()
            stem = s[max(0, m.start() - 40) : m.start() + len(marks)]
            if rest[0] in ",،؛;:.…":
                continue
            if set(marks) <= {".", "…"}:
                if len(marks) > 1 and set(marks) == {"."} and len(marks) != 4 and len(marks) != 2:
                    continue
                if "…" in marks:
                    continue
                if len(marks) == 1 and _abbreviated(stem, lexicon, page):
                    continue
                if len(marks) == 1 and re.search(r"\s\.$", stem):
                    continue
            if marks == "|" and re.search(r"\s\|$", stem):
                continue
            word = re.match(r"[^\s.,!?।،؟]+", rest)
            if re.search(r"[”»\"]", m.group()) and word and word.group() in lexicon.reporter:
                continue
            starts.append(e)
        if script == "deva":
            # A word that nearly always ends a sentence in the corpus ends one here, though its mark was lost.
            for m in re.finditer(r"([^\s.,!?;:।|“”\"]+)\s+(?=[^\s”])", s):
                if m.group(1) in lexicon.closing:
                    starts.append(m.end())
            starts = sorted(set(starts))
    line = np.searchsorted(at, np.array(starts, int), side="right") - 1 if starts else np.zeros(0, int)
    return [int(origin[i] + p - at[i]) for p, i in zip(starts, line, strict=True)]


def _script(text: str) -> str:
    """The script that decides how units are found: more than four tenths of the letters and vowel signs.

    A text of a script with capitals that has none is read like a script without them.
    """
    plain = "space" if text == text.lower() else "cased"
    if text.isascii():
        return plain
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = int((c > 0x40).sum()) or 1
    if int(((c >= 0x590) & (c < 0x1E00) | (c >= 0x3000)).sum()) <= 0.4 * letters:
        return plain
    for name, spans in _SPANS.items():
        if sum(int(((c >= a) & (c <= b)).sum()) for a, b in spans) > 0.4 * letters:
            return name
    return plain


def _stream_starts(text: str | None, label: str | None, boxes: np.ndarray | None, lexicon: Lexicon) -> list[tuple[list[Line], list[int]]]:
    """A page's streams, each with the offsets of the first characters of its units. Null and blank texts have none.

    ``boxes`` has a row (x0, y0, x1, y1) for each line that is not blank, or is None.
    """
    if not text or text.isspace():
        return []
    lines, known = page_lines(text, boxes)
    script = _script(text)
    words = set(text.split()) if script == "cased" else set()
    lang = lexicon.language(label, words) if script == "cased" else label or ""
    common = lexicon.common.get(lang, set())
    german = lang == "de"
    page = Page(text, german)
    out: list[tuple[list[Line], list[int]]] = []
    for kind, part in streams(text, lines, known, common):
        if kind == "headline":
            s = text[part[0].begin : part[0].end]
            out.append((part, [part[0].begin + len(s) - len(s.lstrip())]))
            continue
        own_script = script
        if kind == "advert":
            s = " ".join(text[v.begin : v.end] for v in part)
            own_script = _script(s)
        if own_script == "cased":
            out.append((part, cased_starts(text, part, common, lexicon, page, german, kind == "advert" and _capitals(s))))
        else:
            out.append((part, uncased_starts(text, part, own_script, lexicon, page)))
    return out


def unit_starts(text: str | None, label: str | None, boxes: np.ndarray | None, lexicon: Lexicon) -> list[int]:
    """Offsets of the first characters of a page's units, in order."""
    return sorted({s for _, starts in _stream_starts(text, label, boxes, lexicon) for s in starts})


def unit_spans(text: str | None, label: str | None, boxes: np.ndarray | None, lexicon: Lexicon) -> list[list[tuple[int, int]]]:
    """The spans of a page's units in the order of their starts; a unit that nothing interrupts has one."""
    out: dict[int, list[tuple[int, int]]] = {}
    for lines, starts in _stream_starts(text, label, boxes, lexicon):
        unit = None
        for line in lines:
            inside = sorted({s for s in starts if line.begin <= s < line.end})
            for a, b in zip([line.begin, *inside], [*inside, line.end], strict=True):
                unit = out.setdefault(a, []) if a in inside else unit
                part = text[a:b]
                if unit is None or not part.strip():
                    continue
                a, b = a + len(part) - len(part.lstrip()), a + len(part.rstrip())
                if unit and unit[-1][1] <= a and not text[unit[-1][1] : a].strip():
                    a = unit.pop()[0]
                unit.append((a, b))
    return [out[s] or [(s, s)] for s in sorted(out)]


def sentence_units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", boxes_col: str | None = "line_boxes", rarest: int = 100_000, whole: bool = False) -> DataFrame:
    """``(id, unit, start_char)``: one row per unit, ``unit`` counting them in the order of their starts.

    With ``whole`` also ``end_char`` (after its last character), ``spans`` (several where an advert or a
    column interrupts it) and ``text``, the whole text of the spans, with a line feed between two.

    ``start_char`` is the 0-based code-point offset of the unit's first character, marks that open it
    included. Null, empty and blank texts give no rows. The language label is only a hint; boxes that are
    null or do not match the lines are not used. Texts of any length are read whole; repeated ids give
    repeated rows; an empty table gives an empty result. The lexicon has at most ``rarest`` entries.
    """
    rows = word_counts(df, text_col, lang_col, rarest).collect()
    shared = df.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])
    kind = df.schema[id_col].dataType.simpleString()
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    corner = [F.col(f"{boxes_col}.{c}").cast("array<int>") if boxes_col else F.lit(None).cast("array<int>") for c in ("x0", "y0", "x1", "y1")]
    pages = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lang.alias("lang"), *[c.alias(n) for c, n in zip(corner, ("x0", "y0", "x1", "y1"), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            corners = [batch.column(k) for k in range(3, 7)]
            offsets = corners[0].offsets.to_numpy()
            valid = corners[0].is_valid().to_numpy(zero_copy_only=False)
            flat = np.stack([c.values.fill_null(0).to_numpy(zero_copy_only=False) for c in corners], 1) if len(corners[0].values) else np.zeros((0, 4), int)
            who, unit, start, spans = [], [], [], []
            end, full = [], []
            for i, (text, label) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                box = flat[offsets[i] : offsets[i + 1]] if valid[i] else None
                if whole:
                    own = unit_spans(text, label, box, lexicon)
                    found = [u[0][0] for u in own]
                    spans += [[{"begin": a, "end": b} for a, b in u] for u in own]
                    end += [u[-1][1] for u in own]
                    full += ["\n".join(text[a:b] for a, b in u) for u in own]
                else:
                    found = unit_starts(text, label, box, lexicon)
                who += [ids[i]] * len(found)
                unit += range(len(found))
                start += found
            cols = {"id": pa.array(who, batch.column(0).type), "unit": pa.array(unit, pa.int32()), "start_char": pa.array(start, pa.int64())}
            if whole:
                span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
                cols |= {"end_char": pa.array(end, pa.int64()), "spans": pa.array(spans, pa.list_(span)), "text": pa.array(full, pa.string())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    more = ", end_char long, spans array<struct<begin: long, end: long>>, text string" if whole else ""
    return pages.mapInArrow(run, f"id {kind}, unit int, start_char long{more}").withColumnRenamed("id", id_col)
