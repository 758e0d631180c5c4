"""Personal data: exact patterns, and a linear-chain conditional random field beside them.

The patterns (e-mail, IPv4 address, payment card, phone number) give the base spans. The field
labels words by their shape and small lexicons, and those of their neighbours, with B- and I-tags
of the same four kinds; it is trained on the driver from the small labelled table `LABELLED`,
broadcast (its size follows from the table), and decoded by Viterbi in numpy batches over whole
texts. Its spans are added where they touch no base span: written-out and masked addresses,
numbers without a plus sign, cards with other separators. Base spans always stay.

Defined results: a null or empty text has no spans. Rows are judged alone, whole; offsets are in
code points, the end exclusive. Repeated rows give repeated results, an empty table an empty one.
Columns of the input are carried along, whatever their names; those made here start with `pi_`,
and an input column of the same name gives way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import crf
from .common import groups, packed, unpacked

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]
CACHE_WORDS = 300_000
CACHE_CLASSES = 50_000

ANY = re.compile(r"[0-9@]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does: from within, it would end alike
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield "email", a, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[Span]:
    """The spans of the exact patterns, leftmost and non-overlapping for each kind, in order of
    start and then kind."""
    if not text or not ANY.search(text):
        return []
    out = list(_emails(text))
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


#: The labelled table: words, with spans in brackets as [kind words]. %x and %X stand for a name, %h
#: for a host's name, %t for a top-level domain, %1 to %9 for so many digits, %o for a number to 255;
#: each line is filled in COPIES times.
LABELLED = """
write to [email %x at %h dot %t] if you can
mail me at [email %x dot %x at %h dot %h dot %t] today
my address is [email %x (at) %h (dot) %t] thanks
contact [email %x [at] %h [dot] %t] for more
reach us : [email %x at %h dot co dot %t] or come by
e-mail [email %x%2 at %h dot %t] , please
[email %x at %h dot %t] is where to send it
email [email %x_m (at) %h (dot) %t] or wait
just mail [email %x dot %x at %h dot %t] , she knows
ask %X at [email %x dot %x at %h dot %t] about it
reach %X at [email %x at %h dot %t] by friday
reach %X at [email %x dot %x at %h dot %t]
you can find %X at [email %x%2 at %h dot %t] now
send it to [email %x_%x(at)%h.%t] by friday
[email %x.%x(at)%h.%t]
it is [email %x[at]%h.%t] , she said
or [email %x.%x[at]%h[dot]%t] for the office
mail [email %x[at]%h[dot]%t] for more
the address is [email %x.%x[at]%h[dot]%t] , write
all of it goes to [email %x dot %x at %h dot %t] and %X
[email %x dot %x at %h dot %t] will answer you
then [email %x_%x(at)%h.%t] or nobody
is [email %x.%x(at)%h.%t] still yours
[email %x%2(at)%h.%t] was the old one
he gave us [email %x(at)%h(dot)%t] at last
schreib an [email %x (at) %h.%t] bitte
correo : [email %x at %h dot %t] por favor
ou à [email %x arobase %h point %t] svp
%X was at home with a dot on his nose
look at the dot there and at the line
%X met %X at the station at noon
%X at work and %X at school all day
a dot on the map and a dot at the end
put the dot at the end of the line
the dot com boom ended in 20%2
meet at %h (at the corner) at 5
version 2 dot 5 is out at last
call [phone %3-%3-%4] now
call me on [phone (%3) %3-%4] before noon
tel [phone 0%2 %7] or write
phone : [phone %3-%3-%4] , ask for her
tel: [phone 0%1 %2 %2 %2 %2] le matin
fax [phone (0%2) %3 %4] bitte
mobile [phone 0%3-%7] only
telefono [phone %2 %3 %2 %2] por la tarde
my number is [phone %3-%3-%4] and hers [phone (%3) %3-%4]
whatsapp [phone 0%4 %6] any time
ring [phone (0)%2 %4 %4] for details
my cell is [phone %9%1]
her cell : [phone %9%1] or the office
text me at [phone %3.%3.%4] please
phone [phone %9%1] after six
handy [phone 0%2%8] anrufen
reach me by phone : [phone %3 %3 %4]
[phone %3-%3-%4] is my cell
order number %3-%3-%4 was sent
order number %9%1 was sent
order %3-%3-%4 is on its way
ticket number %3-%3-%4 is closed
invoice no %3-%3-%4 of may
part number %3-%3-%4 fits
tracking number %9%1 for the parcel
reference number %9 in the letter
case number %3-%3-%4 was heard
the serial number is %3-%3-%4 on the back
connect to [ip %o dot %o dot %o dot %o] first
the server is at [ip %o dot %o dot %o dot %o] now
they found [ip %o[.]%o[.]%o[.]%o] among others
then [ip %o(.)%o(.)%o(.)%o] and [ip %o[.]%o[.]%o[.]%o] came up
ping [ip %o[.]%o[.]%o[.]%o] once
host [ip %o(.)%o(.)%o(.)%o] is down
blocked [ip %o[.]%o[.]%o[.]%o] today
[ip %o dot %o dot %o dot %o] did not answer
gateway : [ip %o . %o . %o . %o] by default
ip [ip %o . %o . %o . %o] is free
address [ip %o (dot) %o (dot) %o (dot) %o] was seen
traffic from [ip %o[dot]%o[dot]%o[dot]%o] grew
chapter %1 . %1 of the book
steps %1 . %1 . %1 in the list
release %1 dot %1 dot %1 is out
it went from %1 to %1 dot %1 per cent
card [card %4.%4.%4.%4] was charged
card number [card %4/%4/%4/%4] please
visa [card %4 / %4 / %4 / %4] until may
pay with [card %4 - %4 - %4 - %4] then
my card is [card %4_%4_%4_%4] and the code
mastercard : [card %4.%4.%4.%4] , thanks
karte [card %4/%4/%4/%4] bitte
tarjeta [card %4 . %4 . %4 . %4] vale
amex [card %4.%6.%5] was used
charged to [card %4.%4.%4.%4] twice
from 19%2 / 19%2 and 20%2 / 20%2 on
scores of %4 / %4 in the test
the years 19%2 - 19%2 and 20%2 - 20%2
see chapter 3 and table 12 on page %3
in 20%2 there were 1,%3 of them
from 10:30 to 11:45 on 20%2-05-17
it costs %2.50 or %4 for all
on 12/05/20%2 at 9 in the hall
token = "%6a%6b%4d%6c%5" that was it
password=%2e%1b%1d%1b%1fc%6 and more
key AKIA%4EXAMPLE in the file
id %8%8 in the list
order %9%3 was sent in 3 parts
serial %2-%3-%2 of 19%2
he won 3-2 and then 21-19 in %2 minutes
room %3 , floor 5 , house %4
%4 : %3 - %2 = %3
call him in %2 minutes or at 5
phone %2 models were sold in 20%2
tel aviv has %6 people in 20%2
isbn 978-%1-%2-%6-%1 is a book
the %1 of us were at home at 8
licensed under the apache license , version 2.0
at 4.0 it was under cc by-nc 4.0
write %1 pages or %2 at most
item %3-%4 of the list
he was at %x at %h at noon and at %x at six
at at at at at at at at
%x at %h is at %x at %h
at %x at it at %h , at last
de de de de de de it it it it se se se se
%x dot %x dot %x and a dot
and the people of this town went on with what they had
this is the way that things were done in those days
### the *** of &&& and %% to $$$ here
the&&& %x### of** %x*** to%% %h$$$ and&&& %x,** here$$$ that.&&& in.
%X### the&&& %x*** %h$$$ by%% at&&& dot$$$ it,### was.*** %x## %2&& and
word | word | %x | %h, | word. | %x | %2 | word
see http://%h.%t/%x and www.%h.%t for it
it's a well-known fact, e.g. in (%x) or [%1] and %x/%x
def %x(%x): return %x_%x[%1] + '%h.%t'
a = %x.%x(%2) ; b = [%1, %2] ; %x->%h
<b>%x</b> & <i>%h</i> "%x" - %x ; %x: %2%%
"""
COPIES = 4
NAMES = "anna ben carla david eva frank greta hugo ines jon kim lena max nora otto paul rosa sven tom uma maria lopez berg smith doe lee".split()
HOSTS = "mail web post shop firma site box uni home work store gmail example acme".split()
DOMAINS = "com org net de fr es uk io edu se".split()

LABELS = ["O", *(f"{b}-{k}" for k in KINDS for b in "BI")]
WORD = re.compile(r"\S+")
EDGE = ".,;:!?\"'"
TRIM_LEFT, TRIM_RIGHT = "\"'<", ".,;:!?\"'>"
#: Lexicons: words that go before a kind, before numbers of other kinds, and ends of addresses.
CUES = {
    "phone": set("call tel phone fax mobile cell telefono teléfono téléphone telefon whatsapp ring handy text anrufen".split()),
    "mail": set("mail e-mail email write contact reach correo send schreib".split()),
    "card": set("card visa mastercard amex karte tarjeta carte charged pay".split()),
    "net": set("ip server host gateway ping connect traffic blocked address".split()),
    "other": set("order ticket invoice part tracking reference case serial isbn id version release chapter item page".split()),
    "number": set("number no nummer numéro número".split()),
    "tld": {"com", "org", "net", "edu", "gov", "info", "uk", "io", "eu"},  # not those that are words too
}
JOINS = {"at": "at", "(at)": "at", "[at]": "at", "arobase": "at", "dot": "dot", "(dot)": "dot", "[dot]": "dot", "point": "dot", ".": "mark", "/": "mark", "-": "mark"}
INNER = re.compile(r"[\w.+-][\[(](at|dot)[\])]\w")
QUAD = re.compile(r"[0-9]{1,3}([^0-9]+[0-9]{1,3}){3}")
FOURS = re.compile(r"[0-9]{4}([^0-9 ]+[0-9]{4}){3}")
NEAR = 3  # words on either side whose features count


#: The features of plain words, of letters alone and in no lexicon: small, and with a capital.
PLAIN = [("s=a",), ("s=a", "cap")]
LEXICON = frozenset().union(*CUES.values(), JOINS)


def shape(word: str) -> tuple[str, ...]:
    """Features of a word by itself: shape, digits, what it joins, lexicons."""
    w = word.strip(EDGE)
    if w.isalpha() and w.lower() not in LEXICON:
        return PLAIN[w[0].isupper()]
    if word in JOINS or word.lower() in JOINS:
        low = word.lower()
        return (f"join={JOINS[low]}", "bracket" if low[0] in "([" else "bare")
    low = w.lower()
    runs = re.sub(r"9+", "9", re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", low)))[:24]
    digits = sum(c.isdigit() for c in w)
    out = [f"s={runs}"]
    if digits:
        out += [f"n={min(digits, 12)}", f"l={re.sub('[^0-9]', '.', re.sub('[0-9]', '9', low))[:20]}"]
        if runs == "9":
            out.append(f"i={len(low)}")
            if len(low) <= 3 and low.isascii() and int(low) <= 255:
                out.append("byte")
        if any(c.isalpha() for c in w):
            out.append("mixed")
        if low[0] == "0" and len(low) > 1:
            out.append("zero")
        if QUAD.fullmatch(w):
            out.append("quad")
        elif FOURS.fullmatch(w):
            out.append("fours")
    elif inner := INNER.search(low):
        out.append(f"inner={inner[1]}")
    if w[:1].isupper():
        out.append("cap")
    out += [f"cue={cue}" for cue, words in CUES.items() if low in words]
    if not w.isalpha() and word != w:
        out.append("edge")
    if not w.isalnum() and (signs := set(w).difference("-._()[]/@'") - set(filter(str.isalnum, w))):
        out += ["sign", f"sign={min(signs)}"]
    return tuple(out)




def filled(table: str = LABELLED, copies: int = COPIES, seed: int = 5) -> list[str]:
    """The lines of the table with names and digits put in."""
    r = np.random.default_rng(seed)
    pick = lambda x: x[int(r.integers(len(x)))]

    def put(m: re.Match) -> str:
        c = m[1]
        if c.isdigit():
            return "".join(str(r.integers(0 if i else 1, 10)) for i in range(int(c)))
        return {"x": lambda: pick(NAMES), "X": lambda: pick(NAMES).capitalize(), "h": lambda: pick(HOSTS), "t": lambda: pick(DOMAINS), "o": lambda: str(r.integers(256))}[c]()

    return [re.sub(r"%([xXhto1-9])", put, line) for _ in range(copies) for line in table.strip().split("\n")]


def labelled_chains(lines: list[str]) -> list[tuple[list[str], list[str]]]:
    out = []
    for line in lines:
        words, tags, kind, first = [], [], "", False
        for w in line.split():
            if w[0] == "[" and w[1:] in KINDS:
                kind, first = w[1:], True
                continue
            end = bool(kind) and w.endswith("]") and w not in ("[at]", "[dot]")
            words.append(w[:-1] if end else w)
            tags.append((("B-" if first else "I-") + kind) if kind else "O")
            first = False
            if end:
                kind = ""
        out.append((words, tags))
    return out


def features(words: list[str]) -> list[list[str]]:
    """Features of each word of a chain: its own, and those of NEAR neighbours on either side."""
    edge = [("end",)] * NEAR
    own = [*edge, *map(shape, words), *edge]
    return [[f if d == 0 else f"{d}:{f}" for d in range(-NEAR, NEAR + 1) for f in own[i + d]] for i in range(NEAR, len(own) - NEAR)]


class _Codes(dict):
    """Word -> class, filled in as words are met."""

    def __init__(self, classes: dict[tuple[str, ...], int]) -> None:
        self.classes = classes

    def __missing__(self, word: str) -> int:
        code = self[word] = self.classes.setdefault(shape(word), len(self.classes))
        return code

    def __reduce__(self):
        return _Codes, (self.classes,)


class Model:
    """The trained field. Words are coded by class (all words of equal features), a class by its part
    in the label scores of the words around it.

    In a run of plain words the best path is O: `reach` is how many such words on either side of any
    other word settle that, worked out from the weights. So only the words within reach of one that
    is not plain are decoded, with the labels that whole-text Viterbi gives them."""

    def __init__(self, lines: list[str] | None = None) -> None:
        chains = labelled_chains(filled() if lines is None else lines)
        self.index: dict[str, int] = {}
        rows = [[self.index.setdefault(f, len(self.index)) for f in fs] for words, _ in chains for fs in features(words)]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        labels = np.array([LABELS.index(t) for _, tags in chains for t in tags])
        self.w, self.start, self.trans = crf.train(
            np.array([f for r in rows for f in r]), offsets, np.arange(len(rows)), labels, np.array([len(w) for w, _ in chains]), len(self.index), len(LABELS), rounds=250, ridge=1e-3
        )
        # tags must follow one another: I-x only after B-x or I-x
        for j, b in enumerate(LABELS):
            if b[0] == "I":
                self.start[j] = -1e9
                for i, a in enumerate(LABELS):
                    if a[1:] != b[1:] or a == "O":
                        self.trans[i, j] = -1e9
        self.classes: dict[tuple[str, ...], int] = {("end",): 0, **{f: i + 1 for i, f in enumerate(PLAIN)}}
        self.parts = np.zeros((64, 2 * NEAR + 1, len(LABELS)))
        self.done = 0  # classes whose parts are worked out
        self._extend()
        self.known = _Codes(self.classes)
        self.reach = self._reach()

    def _extend(self) -> None:
        new = list(islice(reversed(self.classes), len(self.classes) - self.done))[::-1]
        if len(self.classes) > len(self.parts):
            self.parts = np.concatenate([self.parts, np.zeros((len(self.classes), *self.parts.shape[1:]))])
        for k, fs in enumerate(new, self.done):
            for d in range(-NEAR, NEAR + 1):
                at = [self.index[n] for n in (f if d == 0 else f"{d}:{f}" for f in fs) if n in self.index]
                self.parts[k, d + NEAR] = self.w[at].sum(axis=0)
        self.done = len(self.classes)

    def forget(self) -> None:
        """Keeps what is remembered of words within bounds; codes given out before no longer hold."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        if len(self.classes) > CACHE_CLASSES:
            base = list(self.classes.items())[: 1 + len(PLAIN)]
            self.classes.clear()
            self.classes.update(base)
            self.known.clear()
            self.done = len(base)

    def _reach(self) -> int:
        """The fewest plain words that settle on O whatever comes before or after them."""
        own = self.parts[1 : 1 + len(PLAIN)]
        # how much less any other label scores than O, at least, among plain words
        margin = (own[:, :, :1] - own[:, :, 1:]).min(axis=0).sum(axis=0).min()
        if margin <= 0:
            raise ValueError("plain words are not outside in this model")
        finite = self.trans[self.trans > -1e8]
        # a stretch of so many without an O would lose to one of O alone
        need = int(np.ceil(2 * (finite.max() - finite.min()) / margin)) + 1
        # and between two O's no excursion pays
        best = self.trans[0, 1:] - margin
        for m in range(1, 2 * need + 2):
            if (best + self.trans[1:, 0]).max() > (m + 1) * self.trans[0, 0]:
                raise ValueError("plain words are not outside in this model")
            best = (best[:, None] + self.trans[1:, 1:]).max(axis=0) - margin
        return need + NEAR

    def code(self, words: list[str]) -> np.ndarray:
        """The class of each word."""
        codes = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if len(self.classes) > self.done:
            self._extend()
        return codes

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Label scores of the inner words, the first and last NEAR of the codes being context only."""
        n = len(codes) - 2 * NEAR
        return sum(self.parts[codes[NEAR + d : NEAR + d + n], d + NEAR] for d in range(-NEAR, NEAR + 1))

    def tags(self, chains: list[list[str]]) -> list[list[str]]:
        """The best tags of each whole chain of words."""
        return [self.decode([(self.pad(self.code(c)), 0, len(c))])[0] for c in chains]

    def pad(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(NEAR, np.int64), codes, np.zeros(NEAR, np.int64)])

    def decode(self, parts: list[tuple[np.ndarray, int, int]]) -> list[list[str]]:
        """Tags of words lo to hi of padded codes, for each (codes, lo, hi); a part that begins or ends
        inside its text begins or ends with O."""
        if not parts:
            return []
        emits = []
        for codes, lo, hi in parts:
            e = self.scores(codes[lo : hi + 2 * NEAR])
            if lo:
                e[0, 1:] -= 1e9
                e[0, 0] -= self.start[0]
            if hi < len(codes) - 2 * NEAR:
                e[-1, 1:] -= 1e9
            emits.append(e)
        best = crf.viterbi(np.concatenate(emits), np.array([hi - lo for _, lo, hi in parts]), self.start, self.trans).tolist()
        out, at = [], 0
        for _, lo, hi in parts:
            out.append([LABELS[k] for k in best[at : at + hi - lo]])
            at += hi - lo
        return out


@lru_cache(maxsize=1)
def model() -> Model:
    return Model()


def _windows(codes: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Runs of words within reach of one that is not plain."""
    at = np.flatnonzero(codes > len(PLAIN))
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 2 * reach) + 1
    firsts, lasts = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])]
    return list(zip(np.maximum(0, firsts - reach).tolist(), np.minimum(len(codes), lasts + reach + 1).tolist()))


def find(texts: list[str], m: Model | None = None) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all its spans, both in order."""
    m = model() if m is None else m
    m.forget()
    base = [base_spans(t) for t in texts]
    parts, owner = [], []
    for i, t in enumerate(texts):
        words = t.split()
        if words:
            codes = m.code(words)
            windows = _windows(codes, m.reach)
            if windows:
                padded = m.pad(codes)
                parts += [(padded, lo, hi) for lo, hi in windows]
                owner += [(i, lo) for lo, _ in windows]
    extra: list[list[Span]] = [[] for _ in texts]
    tagged: dict[int, list[tuple[str, int, int]]] = {}
    for (i, lo), tags in zip(owner, m.decode(parts)):
        k = 0
        while k < len(tags):
            if tags[k][0] != "B":
                k += 1
                continue
            j = k + 1
            while j < len(tags) and tags[j] == "I" + tags[k][1:]:
                j += 1
            tagged.setdefault(i, []).append((tags[k][2:], lo + k, lo + j - 1))
            k = j
    for i, found in tagged.items():
        ends = {p for _, a, e in found for p in (a, e)}
        places = {k: w.span() for k, w in enumerate(WORD.finditer(texts[i])) if k in ends}
        for kind, first, last in found:
            a, e = places[first][0], places[last][1]
            while a < e and texts[i][a] in TRIM_LEFT:
                a += 1
            while e > a and texts[i][e - 1] in TRIM_RIGHT:
                e -= 1
            if e > a and not any(s < e and a < z for _, s, z in base[i]):
                extra[i].append((kind, a, e))
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return [(b, sorted([*b, *x], key=order)) for b, x in zip(base, extra)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{e}" for k, a, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans as one."""
    out, at = [], 0
    for k, a, e in spans:
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, redacted: bool = False) -> DataFrame:
    """The columns `keep` of docs (all but the text by default) with `pi_base` and `pi_spans` (array of
    kind, start, end) and, if asked for, `pi_text`, the text with the spans replaced (null stays
    null)."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    spans = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    made = [T.StructField("pi_base", spans), T.StructField("pi_spans", spans), *([T.StructField("pi_text", T.StringType())] if redacted else [])]
    names = [f.name for f in made]
    src = packed(docs, keep, names, text=F.col(f"`{text_col}`"))
    schema = T.StructType([src.schema["row"], *made])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda spans: [{"kind": k, "start": a, "end": e} for k, a, e in spans]
        for b in groups(batches, 1):
            texts = b.column(1).to_pylist()
            got = find([t or "" for t in texts], shared.value)
            cols = [pa.array([rows(x) for x, _ in got], kind), pa.array([rows(x) for _, x in got], kind)]
            if redacted:
                cols.append(pa.array([None if t is None else redact(t, x) for t, (_, x) in zip(texts, got)], pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["row", *names])

    return unpacked(src.mapInArrow(run, schema), *names)
