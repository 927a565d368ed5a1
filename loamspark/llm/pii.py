"""Operator 6: identifiers of persons, found behind disguises and mapped back to source characters.

Transducers read the text and write a normalised one, keeping for every change which source
characters it came from:

1. homoglyphs: full-width forms, Greek and Cyrillic look-alikes and foreign digits become ASCII,
   one character for one;
2. invisible characters are dropped, "[at]", "(dot)" and the like become "@" and ".", "name at host
   dot com" becomes "name@host.com", runs of spelled digits (English, German, French, Spanish, also
   mixed with digits) become digits. After a bare "at" a host ends in a top-level domain of IANA's list;
   after "@" or "[at]", and after a name with digits or punctuation before a spelled dot, in any
   letters. "name at host.tld" with a name of letters only is taken at mail providers' hosts and after
   a cue such as "mail" or "contact", as texts name sites in the same way ("available at host.tld").

Identifiers are detected in the normalised text: e-mail addresses, IP addresses, bank accounts
(IBAN, checked modulo 97), cards (13 to 19 digits; 16 digits or a valid Luhn sum), US social security
numbers, phone numbers, and secrets (keys, tokens, passwords). Of secrets, addresses and bank accounts
that overlap the first in KINDS is taken. Cards, social security and phone numbers are sought in what
these leave of a run of digits, however long: of all that fit there, those that cover most digits, so
that one number doesn't swallow part of the next. Cards are sought from and to all borders of groups
(_cards), then in any grouping in what is left; a phone number with a plus sign ends at any border of
groups, after "+1" at 11 digits. A found span's ends are mapped back, so a disguised character counts
whole.

Whole texts are read, and time grows with their length: numerals, edits and spans are each gone through
once, in order. A host has at most the 127 labels that the domain name system allows; a name before "at"
64 characters, as mail allows. Null and empty texts have no span and are kept as they are; a null doc_id is
carried as null; repeated rows have the same spans each; an empty table gives an empty result. Other columns, whatever their names, are
carried along by `masked` and not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .top_domains import TOP_DOMAINS

KINDS = ("secret", "email", "iban", "ip", "card", "ssn", "phone")

_LOOKS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ӏ": "l", "ո": "n", "ɡ": "g", "ı": "i", "ν": "v", "ο": "o", "α": "a", "ρ": "p", "κ": "k", "τ": "t", "ι": "i", "υ": "u", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ѕ": "S", "Ј": "J", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "﹫": "@", "﹒": ".", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", "﹣": "-", "\u00a0": " ", "\u2009": " ", "\u202f": " ", "\u3000": " "}
TABLE = {ord(k): v for k, v in _LOOKS.items()} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
for _zero in (0x660, 0x6F0, 0x966, *range(0x1D7CE, 0x1D7FF, 10)):
    TABLE |= {_zero + d: str(d) for d in range(10)}
TABLE |= {0x2080 + d: str(d) for d in range(10)} | {0x2070: "0", 0xB9: "1", 0xB2: "2", 0xB3: "3"} | {0x2070 + d: str(d) for d in range(4, 10)} | {0x2460 + d: str(d + 1) for d in range(9)} | {0x24EA: "0"}
_HOMO = re.compile("[" + "".join(map(re.escape, map(chr, sorted(TABLE)))) + "]")

_DIGITS = {}
for _words in (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
):
    for _d, _word in enumerate(_words.split()):
        _DIGITS[_word] = str(_d)
_DIGITS |= {"oh": "0", "zwo": "2"}
_D = "(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + ")"
#: A spelled digit or a group of digits; runs of these are taken of which three in a row are spelled, of seven digits or more.
_NUMERAL = re.compile(rf"(?<!\w)(?:(?P<word>{_D})|\d{{1,6}})(?!\w)", re.I)
_APART = re.compile(r"[ ,.\-]{1,3}")
_PLUS_BEFORE = re.compile(r"(?<!\w)(?:\+|plus[ \-]+)\Z", re.I)
#: Sought in lower case first, without flags, which is several times as fast.
_TRIO = re.compile(rf"{_D}[ ,.\-]{{1,3}}{_D}[ ,.\-]{{1,3}}{_D}")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
_AT = r"(?:at|arroba|chez|ät)"
_DOT = r"(?:dot|punkt|punto|point)"
_BRACKET = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:(?P<at>{_AT}|@)|(?P<dot>{_DOT}|\.))\s{{0,3}}[\])}}>]\s{{0,3}}", re.I)
#: After a bare "at" these end a host whatever stands before them; the others of IANA's list are words and names of files too.
_COMMON_TOPS = frozenset("com org net edu gov mil int info biz name io ai app dev co eu uk us ca au nz ie de at ch fr be nl lu es pt it gr pl cz sk hu ro bg dk se no fi is ee lv lt ru ua tr il in cn jp kr tw hk sg br mx ar cl za example test".split())
_FILES = frozenset("cc md mov ps py rs sh so zip".split())
_DETERMINERS = frozenset("a an the this that these those each every any some no my your his her its our their which what one".split())
_MARK = rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:%s)\s{{0,3}}[\])}}>]\s{{0,3}}"
_SEPARATOR = rf"(?:\s{{1,3}}{_DOT}\s{{1,3}}|{_MARK % rf'{_DOT}|[.]'}|\.)"
_ADDRESS = re.compile(rf"(?<![\w.+\-])(?P<local>[\w.+\-]{{1,64}})(?P<at>\s{{1,3}}at\s{{1,3}}|\s{{0,3}}@\s{{0,3}}|{_MARK % rf'{_AT}|@'})(?P<host>[\w\-]{{1,63}}(?:{_SEPARATOR}[\w\-]{{1,63}}){{1,126}})", re.I)
_BETWEEN = re.compile(_SEPARATOR, re.I)
#: "word at host.tld" is an address only at one of these hosts or after one of these cues, as sites are named like that too.
_PROVIDERS = re.compile(r"(?:gmail|googlemail|yahoo|ymail|hotmail|outlook|live|msn|aol|icloud|me|mac|gmx|web|t-online|freenet|proton|protonmail|pm|zoho|mail|inbox|yandex|rambler|fastmail|hey|tutanota|tuta|orange|wanadoo|laposte|free|sfr|libero|comcast|verizon|qq|163|126|naver|hanmail)\.(?:[a-z]{2,3}\.)?[a-z]{2,4}", re.I)
_CUE = re.compile(r"(?:\b(?:e-?mails?|mails?|mailto|contact|reach|write(?: to)?|ask|address|adresse|correo|courriel|kontakt)\b(?: (?:is|me|to|at|for|an|a|de))?\s?:?\s{1,2})\Z", re.I)
_NO_NAMES = frozenset("a all also am an and are as available be been but by can check click do find for found free from go has have here him his home hosted i in info is it its just like listed live located log look me meet more my now of on online only or out over page posted published read register see sign site sites so store that the them there these they this to today up us visit was we website were which with you your".split())
_SPACED_AT = re.compile(r"\sat\s")

_EMAIL = re.compile(r"[A-Za-z0-9_%+\-](?:[A-Za-z0-9._%+\-]{0,62}[A-Za-z0-9_%+\-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.){1,126}[A-Za-z]{2,24}(?![A-Za-z0-9])")
_NUMBERS = re.compile(r"(?<![\w.])[+(]{0,2}\d[\d().\- ]{5,}\d(?!\w)")
_FIRST = re.compile(r"(?<!\w)[+(\d]")
_LAST = re.compile(r"\d(?![\w\-])")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)")
_CARD = re.compile(r"(?<![\w.+])\d(?:[ \-]?\d){12,18}(?![\w])")
#: Groups of digits that cards are sought in.
_CHAIN = re.compile(r"(?<![\w.+])\d+(?:[ \-]\d+)*(?!\w)")
_GROUP = re.compile(r"\d+")
#: How the numbers of issuers with 16 digits begin.
_ISSUER = re.compile(r"4|5[1-5]|2[2-7]|35|6[0245]")
_SSN = re.compile(r"(?<![\w\-])(?!000|666|9)\d{3}([\- ])(?!00)\d\d\1(?!0000)\d{4}(?![\w\-])")
_PHONE = re.compile(r"(?<![\w.\-+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,5}\)[ .\-]?)?\d{1,5}(?:[ .\-]?\d{1,5}){1,5}|(?:1[ .\-])?\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|(?:1[ .\-])?\d{3}([.\-])\d{3}\1\d{4}|\d{3} \d{3}[ \-]\d{4})(?![\w\-])")
#: The first form of _PHONE, to be cut at a border of groups.
_PLUS = re.compile(r"\+\d{1,3}[ .\-]?(?:\(\d{1,5}\)[ .\-]?)?\d{1,5}(?:[ .\-]?\d{1,5}){1,5}")
_PLAIN = re.compile(r"(?<![\w.+\-])\+?\d{7,12}(?!\w)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|eyJ[\w\-]{10,}\.[\w\-]{10,}\.[\w\-]{10,})(?![A-Za-z0-9])|-----BEGIN [A-Z ]*PRIVATE KEY-----|(?i:\b(?:password|passwd|pwd|token|secret|api[_\-]?key|access[_\-]?key)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?P<value>[A-Za-z0-9_\-/+.!@#$%^&*]{8,}))")
_WORTH = re.compile(r"[0-9@]")
_KEYWORDS = ("akia", "gho_", "ghp_", "ghs_", "ghu_", "sk-", "xox", "eyj", "pass", "pwd", "token", "secret", "key")


def _host(m: re.Match, t: str) -> list[tuple[int, int]] | None:
    """The separators of the host in a match of _ADDRESS, as far as it is one."""
    seps = [d.span() for d in _BETWEEN.finditer(t, *m.span("host"))]
    starts = [m.start("host"), *(y for _, y in seps)]
    ends = [*(x for x, _ in seps), m.end("host")]
    labels = [t[x:y].lower() for x, y in zip(starts, ends)]
    local, at = m["local"], m["at"]
    bare = at.strip().lower() == "at"
    mention = at[-1] == "@" and at != "@"  # "thanks @name"
    unlike_word = not local.isalpha()
    for n in range(len(seps), 0, -1):
        top = labels[n]
        spelled = any(t[x:y] != "." for x, y in seps[:n])
        if top not in TOP_DOMAINS:
            continue
        if not bare:
            return seps[:n]
        if top not in _COMMON_TOPS and (labels[0] in _DETERMINERS or not spelled and (local.isdigit() or n == 1 and top in _FILES)):
            continue
        if spelled or unlike_word:
            return seps[:n]
        if local.lower() not in _NO_NAMES and (_PROVIDERS.fullmatch(t, starts[0], ends[n]) or _CUE.search(t, max(0, m.start() - 30), m.start())):
            return seps[:n]
    for n in range(len(seps), 0, -1):
        spelled = any(t[x:y] != "." for x, y in seps[:n])
        if re.fullmatch("[a-z]{2,24}", labels[n]) and not mention and (not bare or spelled and unlike_word and local.strip(".").isascii() and not local.isdigit() and local[-1] != "."):
            return seps[:n]
    return None


def _addresses(t: str) -> Iterator[tuple[int, int, str]]:
    """The edits that make addresses of disguised ones."""
    m = _ADDRESS.search(t)
    while m:
        seps = _host(m, t)
        if seps is None:
            m = _ADDRESS.search(t, m.start("host"))
            continue
        if m["at"] != "@":
            yield *m.span("at"), "@"
        for x, y in seps:
            if t[x:y] != ".":
                yield x, y, "."
        m = _ADDRESS.search(t, seps[-1][1])


def _spelled(t: str) -> Iterator[tuple[int, int, str]]:
    """The edits that make digits of runs of spelled ones, in one pass over the numerals of a text."""

    def edits(run: list[re.Match]) -> Iterator[tuple[int, int, str]]:
        digits = [_DIGITS[m[0].lower()] if m["word"] else m[0] for m in run]
        words = "".join("w" if m["word"] else " " for m in run)
        if "www" in words:
            at = run[0].start()
            plus = _PLUS_BEFORE.search(t, max(0, at - 12), at)
            if sum(map(len, digits)) + (plus is not None) >= 7:
                if plus:
                    yield plus.start(), at, "+"
                for m, end, d in zip(run, [*(x.start() for x in run[1:]), run[-1].end()], digits):
                    yield m.start(), end, d

    run: list[re.Match] = []
    for m in _NUMERAL.finditer(t):
        if run and not _APART.fullmatch(t, run[-1].end(), m.start()):
            yield from edits(run)
            run = []
        run.append(m)
    yield from edits(run)


class Normalised:
    """A normalised text with the way back: changes are (start, end) there and (start, end) in the source."""

    def __init__(self, source: str):
        self.text, self.spelled = source, []
        self._starts: list[int] = []
        self._changes: list[tuple[int, int, int, int]] = []
        if not source.isascii() and _HOMO.search(source):
            self.text = source.translate(TABLE)
        edits: list[tuple[int, int, str, bool]] = []
        t = self.text
        if not t.isascii():
            edits += [(*m.span(), "", False) for m in _INVISIBLE.finditer(t)]
        if edits:  # disguises are sought in what is to be seen; the two maps are composed
            self._apply(edits)
            edits = []
            t = self.text
        if "(" in t or "[" in t or "{" in t or "<" in t:
            edits += [(*m.span(), "@" if m["at"] else ".", False) for m in _BRACKET.finditer(t)]
        low = t.lower()
        if "@" in t or "at" in low and _SPACED_AT.search(low) or any(t[x] == "@" or e == "@" for x, _, e, _ in edits):
            edits += [(*e, False) for e in _addresses(t)]
        if _TRIO.search(low):
            edits += [(*e, True) for e in _spelled(t)]
        if edits:
            self._apply(sorted(edits, key=lambda e: e[:2]))

    def _apply(self, edits: list[tuple[int, int, str, bool]]) -> None:
        """Change the text; edits that begin within an earlier one are left out."""
        out, at, size, changes = [], 0, 0, []
        ends, shifts = [], [0]  # of the edits made: where they end, and by how much all up to each move what follows
        for start, end, new, spelled in edits:
            if start < at:
                continue
            out.append(self.text[at:start])
            size += start - at
            a, b = self.source(start, start)[0], self.source(max(start, end - 1), end)[1]
            changes.append((size, size + len(new), a, b))
            if spelled:
                self.spelled.append((size, size + len(new)))
            out.append(new)
            size += len(new)
            at = end
            ends.append(end)
            shifts.append(shifts[-1] + len(new) - (end - start))
        # earlier changes that stand, moved
        begins, moved = [c[2] for c in changes], []
        for s, e, a, b in self._changes:
            k = bisect_right(begins, a) - 1
            if k < 0 or b > changes[k][3]:
                d = shifts[bisect_right(ends, s)]
                moved.append((s + d, e + d, a, b))
        out.append(self.text[at:])
        self.text = "".join(out)
        self._changes = sorted(changes + moved)
        self._starts = [c[0] for c in self._changes]

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source characters of a span of the normalised text, changed ones counting whole."""
        return self._from(start, True), self._from(end, False)

    def _from(self, at: int, start: bool) -> int:
        k = bisect_right(self._starts, at if start else at - 1) - 1
        # an empty replacement at the place itself belongs to what follows it, not to what precedes
        while k >= 0 and start and self._changes[k][0] == self._changes[k][1] == at:
            return self._changes[k][3]
        if k < 0:
            return at
        s, e, a, b = self._changes[k]
        if at < e or (not start and at == e):
            return a if start else b
        return b + at - e


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Spans:
    """Spans that don't overlap."""

    def __init__(self) -> None:
        self._starts: list[int] = []
        self._ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        k = bisect_right(self._starts, a)
        return (k == 0 or self._ends[k - 1] <= a) and (k == len(self._starts) or b <= self._starts[k])

    def add(self, a: int, b: int) -> bool:
        """Whether the span was free."""
        if not self.free(a, b):
            return False
        k = bisect_right(self._starts, a)
        self._starts.insert(k, a)
        self._ends.insert(k, b)
        return True

    def gaps(self, a: int, b: int) -> list[tuple[int, int]]:
        """What is free of a to b."""
        out, k = [], max(0, bisect_right(self._starts, a) - 1)
        while k < len(self._starts) and self._starts[k] < b:
            if self._starts[k] > a:
                out.append((a, self._starts[k]))
            a = max(a, self._ends[k])
            k += 1
        return [*out, (a, b)] if a < b else out


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def _cards(t: str, a: int, b: int) -> Iterator[tuple[int, int, int]]:
    """Cards beside other numbers: groups of a chain laid out as on cards, and how sure each digit is.

    One group; groups of four digits and more, the last of three and more; single digits in a row. With
    a valid Luhn sum, or 16 digits in one group, or in four groups of four with an issuer's first digits.
    """
    for chain in _CHAIN.finditer(t, a, b):
        if _digits(chain[0]) < 13:
            continue
        groups = [m.span() for m in _GROUP.finditer(t, *chain.span())]
        for i, (x, end) in enumerate(groups):
            digits, fours = "", True
            for j in range(i, min(len(groups), i + 5)):
                c, y = groups[j]
                digits += t[c:y]
                if len(digits) > 19:
                    break
                fours &= y - c == 4
                if len(digits) >= 13 and (j == i or y - c > 2 or len(digits) == 13) and not (j > i and re.match(r"/\d", t[y : y + 2])):
                    if luhn(digits):
                        yield x, y, 2
                    elif len(digits) == 16 and (j == i or fours and j == i + 3 and _ISSUER.match(digits)):
                        yield x, y, 1
                if y - c < 4:
                    break
        i = 0
        while i < len(groups):
            j = i
            while j < len(groups) and groups[j][1] - groups[j][0] == 1:
                j += 1
            digits = "".join(t[x] for x, _ in groups[i:j])
            for k, m in {(0, j - i), *((k, n) for n in (15, 16) for k in (0, j - i - n))}:
                one = digits[k : k + m]
                if k >= 0 and 13 <= len(one) == m <= 19 and (luhn(one) and (m == j - i or one[0] in "3456") or len(one) == 16 == j - i):
                    yield groups[i + k][0], groups[i + k + m - 1][1], 1 + luhn(one)
            i = j + 1


def _phones(t: str, p: int, b: int) -> Iterator[tuple[int, int]]:
    """Spans that may be phone numbers from p on: after a plus sign, all that end at a border of groups."""
    m = _PHONE.match(t, p)
    if m and t[p] != "+":
        yield m.span()
    elif t[p] == "+" and (p == 0 or not (t[p - 1].isalnum() or t[p - 1] in "_.-+")):
        fits = []
        for e in _LAST.finditer(t, p, min(b, p + 64)):
            last = e.end()
            if last < len(t) and (t[last].isalnum() or t[last] in "_-"):
                continue
            if 8 <= _digits(t[p:last]) <= 15 and _PLUS.fullmatch(t, p, last):
                fits.append((p, last))
        if t[p + 1] == "1":  # there numbers have ten digits
            fits = [f for f in fits if _digits(t[p : f[1]]) == 11] or fits
        yield from fits


def _numbers(t: str, a: int, b: int) -> list[tuple[str, int, int]]:
    """Cards, social security and phone numbers in a run: the choice that covers most digits, then the surest."""
    fits = [("card", x, y, sure) for x, y, sure in dict.fromkeys(_cards(t, a, b))]
    for f in _FIRST.finditer(t, a, b):
        p = f.start()
        if (m := _SSN.match(t, p)) and m.end() <= b:
            fits.append(("ssn", *m.span(), 3))
        fits += [("phone", x, y, 2) for x, y in _phones(t, p, b) if y <= b and 8 <= _digits(t[x:y]) <= 15]
    out = _best(t, fits)
    left = Spans()
    for _, x, y in out:
        left.add(x, y)
    for x, y in left.gaps(a, b):
        for m in _CARD.finditer(t, x, y):
            digits = re.sub(r"\D", "", m[0])
            if len(digits) == 16 or luhn(digits):
                out.append(("card", *m.span()))
    return out


def _best(t: str, fits: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int]]:
    if len(fits) < 2:
        return [f[:3] for f in fits]
    fits.sort(key=lambda f: (f[2], -f[1]))
    ends = [f[2] for f in fits]
    best: list[tuple[int, int]] = [(0, 0)]  # of the first n, digits covered and how surely
    take: list[int] = []  # the number of those that end before it, if it is taken
    for n, (_, x, y, sure) in enumerate(fits):
        before = bisect_right(ends, x, 0, n)
        digits = _digits(t[x:y])
        with_it = (best[before][0] + digits, best[before][1] + digits * sure)
        take.append(before if with_it > best[-1] else -1)
        best.append(max(with_it, best[-1]))
    out, n = [], len(fits)
    while n:
        if take[n - 1] < 0:
            n -= 1
        else:
            out.append(fits[n - 1][:3])
            n = take[n - 1]
    return out[::-1]


def detect(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, normalised form) of the identifiers of a text, ends in source characters, in order."""
    if not text:
        return []
    n = Normalised(text)
    t = n.text
    found: list[tuple[int, int, int]] = []

    def add(kind: str, a: int, b: int) -> None:
        found.append((KINDS.index(kind), a, b))

    low = t.lower()
    if any(k in low for k in _KEYWORDS):
        for m in _SECRET.finditer(t):
            add("secret", *(m.span("value") if m["value"] else m.span()))
    runs: list[tuple[int, int]] = []
    if _WORTH.search(t):
        at = t.find("@")
        while at >= 0:
            lo = max(0, at - 64)
            for m in _EMAIL.finditer(t, lo, min(len(t), at + 280)):
                if m.start() < at < m.end():
                    add("email", *m.span())
            at = t.find("@", at + 1)
        runs = [m.span() for m in _NUMBERS.finditer(t)]
        for a, b in runs:
            for m in _IP.finditer(t, a, min(len(t), b + 2)):  # it looks two characters ahead
                add("ip", *m.span())
        for m in _IBAN.finditer(t):
            if _iban(m[0]):
                add("iban", *m.span())
    chosen, taken = [], Spans()
    by_kind = lambda f: (f[0], f[1], -f[2])
    chosen += [f for f in sorted(found, key=by_kind) if taken.add(*f[1:])]
    found.clear()
    for a, b in runs:
        for x, y in taken.gaps(a, b):
            for f in _numbers(t, x, y):
                add(*f)
    for a, b in _joined(n.spelled):
        for m in _PLAIN.finditer(t, a, b):
            add("phone", *m.span())
        for m in _CARD.finditer(t, a, b):
            if luhn(re.sub(r"\D", "", m[0])):
                add("card", *m.span())
    chosen += [f for f in sorted(found, key=by_kind) if taken.add(*f[1:])]
    out = [(KINDS[k], *n.source(a, b), t[a:b]) for k, a, b in chosen]
    return sorted(out, key=lambda s: s[1])


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def mask(text: str | None) -> str | None:
    """The text with each identifier replaced by its kind in angle brackets."""
    spans = detect(text)
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b, _ in spans:
        if a < at:
            continue
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join(out) + text[at:]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, kinds, starts, ends, forms, sources = [], [], [], [], [], []
        for i, text in enumerate(batch.column("text")):
            text = text.as_py()
            for kind, a, b, form in detect(text):
                rows.append(i)
                kinds.append(kind)
                starts.append(a)
                ends.append(b)
                forms.append(form)
                sources.append(text[a:b])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(sources, pa.string()), pa.array(forms, pa.string())], names=["doc_id", "kind", "start_char", "end_char", "source_text", "normalised"])


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([mask(t.as_py()) for t in batch.column("__text")], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=batch.schema.names)


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start_char, end_char, source_text and normalised: a row for each identifier."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_find, "doc_id long, kind string, start_char int, end_char int, source_text string, normalised string")


def masked(docs: DataFrame) -> DataFrame:
    """docs with masked texts, and n_chars, where there is one, counted again."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index("text")]
    plain = docs.toDF(*names).withColumn("__text", F.col(at).cast("string")).drop(at)
    done = plain.mapInArrow(_mask, plain.schema)
    chars = F.length("__text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    of = {"text": F.col("__text"), "n_chars": chars}
    return done.select(*[(of[c] if c in of and of[c] is not None else F.col(n)).alias(c) for n, c in zip(names, docs.columns)])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
