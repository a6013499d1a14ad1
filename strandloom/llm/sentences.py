"""Sentence units of scanned pages in many languages and scripts.

A page is first put back into reading order: lines read across columns are cut at
the gaps, lines belong to the column they start in, of any number of columns, and by their boxes tall lines
are headlines and indented small blocks with a tall title are adverts. Columns and
adverts are flows of their own, so a sentence goes on across a line end, the other
column or an advert. Within a flow, character-property rules decide: terminators
of all scripts, closing quotes and brackets that follow them, abbreviations of the
page's language that never or only before a capital end a sentence, numbers, and speech that goes on
after its closing quote. Every unit is reported by the place of its last character.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations after which a sentence never ends (title, unit, reference), by language.
NEVER = {
    "en": "messrs dr st p pp vol iii ii iv col mr no hon rev mrs capt gen lt maj sgt gov sen rep prof jr fig vs 2s 6d",
    "de": "nr z hr fr dr prof h d st u s bzw ca",
    "fr": "art mm m ex p mme mlle av st dr h fr no pp vol",
    "es": "núm pág sr sra vd d dr m p av ej",
    "it": "sig dott pag prof dr",
    "pt": "sr sra dr núm pág",
    "nl": "dhr mevr nr dr prof",
    "ru": "т стр р ч м им г гг е ул",
    "el": "σελ αρ κκ π.χ δρ αγ κ",
    "ar": "د م أ ص",
}
#: Abbreviations that end a sentence only if the next word starts one.
SOFT = {
    "en": "p.m a.m co &c etc",
    "de": "w usw etc co",
    "fr": "cie etc",
    "es": "etc cía",
    "it": "ecc",
    "pt": "etc cia",
    "nl": "enz",
    "ru": "д пр",
    "el": "κ.λπ κ.τ.λ",
    "ar": "",
}
#: Names of a month that are cut short before the day, in English.
MONTHS = frozenset("jan feb mar apr jun jul aug sept sep oct nov dec".split())
#: Codes of three letters of these languages.
LONG_CODES = {"eng": "en", "ger": "de", "deu": "de", "fre": "fr", "fra": "fr", "spa": "es", "ita": "it", "por": "pt", "dut": "nl", "nld": "nl", "rus": "ru", "gre": "el", "ell": "el", "ara": "ar"}
SCRIPT = {"ru": "Cyrillic", "el": "Greek", "ar": "Arabic"}
#: Capitalised words that do not show that a sentence starts.
ALWAYS_CAPITAL = frozenset("Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split())
#: Words that show it, after initials that could stand in the middle.
OPENERS = frozenset("The A An He She It They We I You In On At But And This That These Those There Then When If As For His Her Its Their Our My No".split())
GERMAN_ORDINAL = re.compile(r"(?:Jan|Feb|März|Apr|Mai|Jun|Jul|Aug|Sep|Okt|Nov|Dez|Jahr)")
#: Words that report speech after a closing quote, in scripts without capitals.
REPORTS = re.compile(r"(?:と\s*(?:言|答|話|述|問|$)|[他她]\s*(?:說|問|说|问|道|答|$)|قال|سأل|पूछा|कहा)")


#: All characters below the planes that hold ideographs only.
_ALL = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)]))


def _having(pattern: str) -> str:
    """All characters with a Unicode property."""
    return "".join(regex.findall(pattern, _ALL))


#: Marks that Unicode lists as ending sentences, in every script; the Tibetan shad, the ellipsis, and what scanners and Greek use.
FULL_STOPS = _having(r"\p{Sentence_Break=ATerm}")
TERMINATOR = re.compile(f"[{FULL_STOPS}{_having(r'\p{Sentence_Break=STerm}')}།༎…｡;\u037e·]+(?:\\s?[!?…])*")
CLOSER = frozenset("”’»›\"'" + _having(r"\p{Pe}|\p{Pf}"))
QUOTES = frozenset("”’»›\"'“«」』〉》")
SPECK = "·|°<>*^~¬­•_=—-–"
RULE = re.compile(r"^[\s\-–—_=*.·•~]+$")
#: A whole line in square brackets, between asterisks, or of tags in angle brackets with a word before or after.
STAMP = re.compile(r"^\s*(?:\[[^\[\]\n]*\]|\*{2,}\s*\w[^*\n]*\*{2,}|\w{0,20}(?:<[^<>\n]{1,30}>)+(?:[ \w]{0,20}))\s*$")
INITIALS = re.compile(r"^[A-Z](?:\.[A-Z])+$")
GAP = re.compile(r"(?<=\S)(?: {4,}|\t+ *| +\t+ *)(?=\S)")
ALNUM = re.compile(r"[^\W_]")
LOWER, UPPER = re.compile(r"[a-zß-öø-ÿά-ώа-яё]"), re.compile(r"[A-ZÀ-ÖØ-ÞΆ-ΫА-ЯЁ]")
THAI, GREEK, DOTLESS = re.compile(r"[ก-๛]"), re.compile(r"[Ͱ-Ͽἀ-῿]"), re.compile(r"[ऀ-ॿ฀-๿぀-ヿ㐀-鿿]")
WORD = re.compile(r"[^\W\d_]")
SPACES = re.compile(r"\s+")
LATIN_WORD, CYRILLIC, ARABIC = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+"), re.compile(r"[Ѐ-ӿ]"), re.compile(r"[\u0600-\u06ff]")
#: Languages here that are not written in Latin letters, so that they say nothing about Latin words on their pages.
OTHER_SCRIPT = frozenset("ru el ar hi ja zh th hin jpn chi zho tha".split())
#: In shares of the page width: least height of a headline, least distance between the starts of two columns, indents of an advert's title and body.
TALL, COLUMN_GAP, TITLE_INDENT, INDENT = 0.021, 0.15, 0.007, 0.011


#: Frequent words that tell a passage's language among those in Latin letters.
FREQUENT = {
    "en": "the of and to was were with that this which from they will not their been have as by for it is be but next",
    "de": "der die das und den dem von mit zu ist nicht auf für eine einen sich bei aus war wurde gegen über",
    "fr": "le les des du et une dans est pour qui sur au aux par cette été contre avec",
    "es": "el los las del una que por con para su se fue esta como al muy más entre",
    "it": "il gli di che della per non una sono nel",
    "pt": "não uma para com foi pelo muito seu",
    "nl": "het een van de niet dat voor zijn met werd",
}
OF_WORD = {w: tuple(c for c in FREQUENT if w in FREQUENT[c].split()) for c in FREQUENT for w in FREQUENT[c].split()}
LATIN_CODES = tuple(c for c in NEVER if c not in SCRIPT)
EVERY = {k: {c: frozenset(v.split()) for c, v in t.items()} for k, t in (("never", NEVER), ("soft", SOFT))}
IN_LATIN = frozenset(w for t in EVERY.values() for c in LATIN_CODES for w in t[c])
#: Longest word that can be an abbreviation, with marks before it.
LONGEST = max(len(w) for t in EVERY.values() for c in t.values() for w in c) + 6
#: Characters on each side of a mark that tell the language of its passage.
PASSAGE = 200


@lru_cache(maxsize=256)
def language(lang: str | None) -> str | None:
    """Code of two letters where the language has one here, any other code as it is; None for a missing or undefined one."""
    code = re.split(r"[-_]", (lang or "").strip().lower())[0]
    code = LONG_CODES.get(code, code)
    return None if not code.isalpha() or len(code) > 3 or code in ("und", "mul", "zxx", "mis") else code


def _languages(s: str, at: int, word: str, lang: str | None) -> tuple[str, ...]:
    """Languages whose abbreviations hold for the word before ``at``.

    A word in Greek, Cyrillic or Arabic letters has the language of its script. Of the
    others, the page's language holds, unless frequent words show that the passage is
    in another (an advert, a quotation); without a page language and without such
    words, every language in Latin letters.
    """
    for c in word:
        if c.isalpha():
            if GREEK.match(c):
                return ("el",)
            if CYRILLIC.match(c):
                return ("ru",)
            if ARABIC.match(c):
                return ("ar",)
            break
    if lang in LATIN_CODES and (word in EVERY["never"][lang] or word in EVERY["soft"][lang]) or word not in IN_LATIN:
        return (lang,) if lang in LATIN_CODES else ()
    counts = dict.fromkeys(LATIN_CODES, 0)
    for w in LATIN_WORD.findall(s, max(0, at - PASSAGE), at + PASSAGE):
        for c in OF_WORD.get(w.lower(), ()):
            counts[c] += 1
    best = max(counts, key=lambda c: (counts[c], c == lang))
    if counts[best] > counts.get(lang, 0):
        return tuple(c for c in LATIN_CODES if counts[c] * 2 >= counts[best])  # of a mixed passage, all that it is made of
    return (lang,) if lang in LATIN_CODES else () if lang and lang not in OTHER_SCRIPT else LATIN_CODES


def columns(x: list[float], width: float) -> list[int]:
    """Column of every box by where it starts: a new one after a gap of ``COLUMN_GAP`` of the page."""
    starts = sorted(set(x))
    firsts = [b for a, b in zip(starts, starts[1:]) if b - a > COLUMN_GAP * width]
    return [bisect_right(firsts, v) for v in x]


class Flow:
    """Text of one stream of lines, with the place of each piece in the page."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.starts: list[int] = []
        self.places: list[int] = []
        self.n = 0

    def add(self, piece: str, place: int) -> None:
        self.parts.append(piece)
        self.starts.append(self.n)
        self.places.append(place)
        self.n += len(piece) + 1

    def text(self) -> str:
        return "\n".join(self.parts)

    def place(self, i: int) -> int:
        k = bisect_right(self.starts, i) - 1
        return self.places[k] + i - self.starts[k]


def _open(flow: Flow) -> bool:
    """Does a flow stop within a sentence?"""
    last = flow.parts[-1].rstrip() if flow.parts else ""
    return bool(last) and last[-1] not in CLOSER and last[-1] not in "“«" and not TERMINATOR.match(last[-1])


def _last_visible(s: str, start: int, end: int) -> int:
    """Index of the last character before ``end`` that is neither white space nor a speck after it."""
    i = end - 1
    while i >= start and (s[i].isspace() or s[i] in SPECK and (i == start or s[i - 1].isspace())):
        i -= 1
    return i


def _ends_sentence(s: str, at: int, end: int, quoted: bool, closed: bool, lang: str | None) -> bool:
    """Does the terminator s[at:...], with closers up to ``end``, end a sentence?"""
    mark = "." if s[at] in FULL_STOPS else s[at]
    n = len(s)
    j = end
    while j < n and (s[j].isspace() or s[j] in SPECK):
        j += 1
    if j >= n:
        return True
    k = j
    while k < n and not s[k].isalnum() and not s[k].isspace():
        k += 1
    c = s[k] if k < n else ""
    next_lower = c.islower()
    if quoted:
        if next_lower or REPORTS.match(s, j):
            return False
        if mark != ".":
            return True
    if mark == ".":
        if at and s[at : at + 2] != "..":
            w = at
            while w > 0 and not s[w - 1].isspace() and at - w < LONGEST:  # longer words are no abbreviation
                w -= 1
            word = s[w:at].lstrip("“”‘’«»„\"'(¡¿[『「")
            low = word.lower()
            spoken = _languages(s, at, low, lang)
            never, soft = (any(low in EVERY[k][c] for c in spoken) for k in ("never", "soft"))
            if not closed:
                if low == "m" and word != "M":  # metres after a number end a sentence like any word
                    b = w - 1
                    while b > 0 and s[b].isspace():
                        b -= 1
                    if b > 0 and s[b].isdigit():
                        return not next_lower
                if never or (len(word) == 1 and word.isupper()):
                    return False
                if INITIALS.match(word):
                    m = k
                    while m < n and s[m].isalnum():
                        m += 1
                    return s[k:m] in OPENERS
                if low in MONTHS and "en" in spoken and c.isdigit():
                    return False
                if word.isdigit() and len(word) <= 2 and GERMAN_ORDINAL.match(s, j):
                    return False
            if soft:
                if low in ("w", "usw"):
                    return True
                if not c.isupper():
                    return not c.islower() and not c.isdigit() and c != ""
                m = k
                while m < n and not s[m].isspace():
                    m += 1
                nxt = s[k:m]
                return not (nxt.rstrip(".,").lower() in EVERY["never"].get(spoken[0], ()) and nxt.endswith(".") or (len(nxt) == 2 and nxt[1] == ".") or nxt.rstrip(".,;!?") in ALWAYS_CAPITAL)
        return not next_lower
    if mark in "…·" or s[at : at + 2] == "..":
        return not next_lower
    return not (closed and next_lower)


def _sentences(s: str, lang: str | None) -> Iterator[int]:
    """Index of the last character of every sentence of a flow that is not Thai."""
    start, n = 0, len(s)
    for m in TERMINATOR.finditer(s):
        at, end = m.start(), m.end()
        if at < start:
            continue
        mark = "." if s[at] in FULL_STOPS else s[at]
        after = s[end] if end < n else " "
        if mark == ".":
            if end - at == 1:
                wide = s[at] == "．" and not (at and s[at - 1].isdigit() and after.isdigit())
                if after.isalnum() and not wide:
                    continue
                if at and DOTLESS.match(s[at - 1]) and not wide:
                    continue
        elif mark == ";" or mark == ";":
            b = at
            while b > start and not s[b - 1].isalpha():
                b -= 1
            if not (b > start and GREEK.match(s[b - 1])):
                continue
        elif mark == "·" and not (at and s[at - 1].isalpha() and not GREEK.match(s[at - 1]) and after.isspace()):
            continue  # but for Greek, whose colon it is, a period that was misread
        quoted = closed = False
        j = end
        while j < n:
            c = s[j]
            if c in CLOSER:
                pass
            elif c == "“" and s.rfind("„", start, at) > s.rfind("“", start, at):
                pass
            elif c == "«" and s.rfind("»", start, at) > s.rfind("«", start, at):
                pass
            elif c in " \u00a0\u202f\n" and j + 1 < n and s[j + 1] in "»›" and (j + 2 >= n or not s[j + 2].isalnum()) and s.rfind("«", start, at) > s.rfind("»", start, at):
                j += 1
            elif c == "\n" and j + 1 < n and s[j + 1] in "”’」』）)" :
                j += 1
            else:
                break
            quoted |= s[j] in QUOTES
            closed = True
            j += 1
        while closed and j < n and s[j] in ".!?。！？…":
            j += 1
        if _ends_sentence(s, at, j, quoted, closed, lang):
            if ALNUM.search(s, start, j):
                yield j - 1
            start = j
    if ALNUM.search(s, start):
        yield _last_visible(s, start, n)


def _thai_sentences(s: str) -> Iterator[int]:
    start, n = 0, len(s)
    for m in SPACES.finditer(s):
        a, b = m.span()
        if m.group() == "\n" or a == 0:
            continue
        if s[a - 1].isdigit() or (b < n and s[b].isdigit()):
            continue
        if ALNUM.search(s, start, a):
            yield a - 1
        start = b
    if ALNUM.search(s, start):
        yield _last_visible(s, start, n)


def page_units(text: str, x0: np.ndarray | None, y0: np.ndarray | None, y1: np.ndarray | None, width: float, lang: str | None = None) -> list[int]:
    """Ends of all units of a page, ascending. Boxes count only if there is one for every line."""
    raw, at, lines = text.split("\n"), 0, []
    for r in raw:
        lines.append((r[:-1] if r.endswith("\r") else r, at))
        at += len(r) + 1
    boxes = x0 is not None and len(x0) == len(lines)
    x = x0.tolist() if boxes else None
    h = (y1 - y0).tolist() if boxes else None
    lang = language(lang)
    column = columns(x, width) if boxes else [0] * len(lines)
    cased = len(LOWER.findall(text)) * 4 > len(WORD.findall(text))
    ends: list[int] = []
    n_cols = max(column, default=0) + 1
    most = max(2, n_cols)  # lines read across may hold a column that has no box of its own
    flows = [Flow() for _ in range(most)]
    heads: list[int | None] = [None] * most  # end of the headline that is open in a column
    headed = [False] * most
    advert: Flow | None = None
    advert_title: int | None = None
    left = min((v for v, c in zip(x, column) if not c), default=0) if boxes else 0
    lengths = sorted(len(s) for s, _ in lines if len(s) > 8)
    usual = lengths[len(lengths) // 2] if lengths else 0

    def close(flow: Flow) -> None:
        if flow.parts:
            s = flow.text()
            thai = THAI.search(s) and len(THAI.findall(s)) * 2 > len(WORD.findall(s))
            ends.extend(flow.place(i) for i in (_thai_sentences(s) if thai else _sentences(s, lang)))

    def headline(col: int, piece: str, place: int) -> None:
        if heads[col] is None:
            close(flows[col])
            flows[col] = Flow()
            headed[col] = True
        heads[col] = place + len(piece.rstrip()) - 1

    def body(col: int, piece: str, place: int) -> None:
        if heads[col] is not None:
            ends.append(heads[col])
            heads[col] = None
        flows[col].add(piece, place)

    def close_advert() -> None:
        nonlocal advert, advert_title
        if advert_title is not None:
            ends.append(advert_title)
            advert_title = None
        if advert is not None:
            close(advert)
            advert = None

    for i, (s, place) in enumerate(lines):
        if not ALNUM.search(s):
            if not s.strip() or (RULE.match(s) and len(s.strip()) > 2):
                if advert is not None and advert.parts:
                    close_advert()
                continue
        elif STAMP.match(s):
            ends.append(place + len(s.rstrip()) - 1)
            continue
        gap = GAP.search(s)
        tall = h[i] >= TALL * width if boxes else None
        if gap:
            close_advert()
            cuts = [g.span() for g in GAP.finditer(s)][: most - 1]
            starts, stops = [0, *[b for _, b in cuts]], [*[a for a, _ in cuts], len(s)]
            sides = [(c, s[a:b], place + a) for c, (a, b) in enumerate(zip(starts, stops))]
            for col, piece, p in sides:
                if not boxes or tall:
                    if cased and (LOWER.search(piece) or UPPER.search(piece)):
                        head = not LOWER.search(piece) and len(UPPER.findall(piece)) > 1
                    else:
                        head = bool(boxes) and (heads[col] is not None or not flows[col].parts) and len(piece) < 0.42 * usual + 3 if not cased and heads[0] is not None else bool(boxes)
                else:
                    head = False
                (headline if head else body)(col, piece, p)
            continue
        if boxes:
            col = column[i]
            indented = x[i] - left >= INDENT * width and not col
            if tall:
                if not col and x[i] - left >= TITLE_INDENT * width:
                    if advert is None or advert.parts:
                        close_advert()
                        advert = Flow()
                    advert_title = place + len(s.rstrip()) - 1
                else:
                    close_advert()
                    headline(col, s, place)
            elif advert is not None and indented:
                if advert_title is not None:
                    ends.append(advert_title)
                    advert_title = None
                advert.add(s, place)
            else:
                close_advert()
                body(col, s, place)
        elif cased and not LOWER.search(s) and len(UPPER.findall(s)) > 2:
            # Capitals within an open sentence are the title of an advert, elsewhere a headline.
            if advert is not None and not advert.parts:
                advert_title = place + len(s.rstrip()) - 1
            elif heads[0] is None and advert is None and _open(flows[0]):
                advert, advert_title = Flow(), place + len(s.rstrip()) - 1
            else:
                close_advert()
                headline(0, s, place)
        elif advert is not None and not (advert.parts and not _open(advert) and s.lstrip()[:1].islower()):
            if advert_title is not None:
                ends.append(advert_title)
                advert_title = None
            advert.add(s, place)
        else:
            close_advert()
            body(0, s, place)
    close_advert()
    ends.extend(e for e in heads if e is not None)
    now = flows[0]
    for col in range(1, most):
        after = flows[col]
        # A column may go on with the last sentence of the one before: in small letters, or, where there are none, without a headline.
        first = after.parts[0].lstrip()[:1] if after.parts else ""
        if now.parts and after.parts and _open(now) and (first.islower() or not cased and not headed[col] and not UPPER.match(first)):
            for piece, p in zip(after.parts, after.places):
                now.add(piece, p)
        else:
            close(now)
            now = after
    close(now)
    return sorted(set(ends))


def _units(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for at in range(0, b.num_rows, 500):
            yield _batch(b.slice(at, 500))


def _batch(b: pa.RecordBatch) -> pa.RecordBatch:
    ids, texts, lines, widths, langs = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist()
    box = lines.flatten()
    fields = [box.field(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in ("x0", "y0", "y1")] if len(box) else [np.zeros(0)] * 3
    n = [0 if x is None else x for x in pa.compute.list_value_length(lines).to_pylist()]
    doc, end, at = [], [], 0
    for i, text, k, w, lang in zip(ids, texts, n, widths, langs):
        if text and not text.isspace():
            part = [f[at : at + k] for f in fields]
            whole = k and not any(np.isnan(p).any() for p in part)
            got = page_units(text, *(part if whole else (None, None, None)), w if w and w > 0 else 2000.0, lang)
            end += got
            doc += [i] * len(got)
        at += k
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(end, pa.int64())], names=["id", "end_pos"])


def sentence_ends(df: DataFrame, id: str, text: str, lines: str, width: str, lang: str) -> DataFrame:
    """``(id, end_pos)``: 0-based code point place of the last character of each unit.

    Empty, blank and null texts have no rows. Without boxes, or with another number
    of them than lines, only capitals and rules tell headlines and adverts.
    lang: language code in any form; for null, undefined and foreign ones see ``_languages``. A page without a width counts as 2,000 wide.
    Texts of any length are read whole, a page in one task. Empty tables give no rows.
    """
    src = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.transform(F.col(lines), lambda b: F.struct(b["x0"].alias("x0"), b["y0"].alias("y0"), b["y1"].alias("y1"))).alias("lines"), F.col(width).cast("double").alias("width"), F.col(lang).alias("lang"))
    return src.mapInArrow(_units, "id long, end_pos long").withColumnRenamed("id", id)
