"""Personal data: four fixed patterns, and a semi-Markov conditional random field for what they miss.

Base patterns (leftmost, non-overlapping, each kind for itself): email, ip, card and phone; matches that fail their test
(parts at most 255, digits and Luhn, digits) are dropped.

Method: a stretch of text around digits, ``@`` and written-out ``at`` or ``dot`` is cut into tokens (runs of ASCII letters and
digits, of other letters, of blanks; every other character by itself).  A labelling cuts it into segments: one token of
no kind, or up to LONGEST tokens of one kind.  A segment is scored as a whole, by features of its shape, its groups of
digits, its checksums, its parts and what stands on either side; neighbouring segments by the pair of their kinds.
Forward and backward sums over all segmentations give the likelihood's gradient, and the best segmentation chooses the
boundaries and kinds of all segments of a stretch at once.  A segment that the hard limits of a kind (characters, number of
digits) rule out is not scored, which bounds the work for a token.

Training: stretches with base spans, at most PER_KIND for each kind and as many without any (least hashes of the text, so
any input has a bounded sample), labelled by these spans.  From each come rewritten copies, labelled alike (an address
with `` at `` for ``@``, an IP in brackets, a card in groups, a phone number without its plus), and copies with look-alikes that
are nothing (a card number that fails its checksum, a date, a version, an amount, a part above 255).  A kind without examples is
not predicted.  Only this sample reaches the driver.

Added spans overlap no base span and no other added span.  Spans count code points, end exclusive.

Edge cases: a null or empty text has no spans; texts are scanned whole, in time linear in their length; repeated rows get a
result each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, ready

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)        # the label of a token of no kind
LONGEST = 30             # tokens of a segment
SIDE = 18                # tokens of an address on either side of its @
AROUND = 48              # characters of context on either side of a trigger
PER_KIND = 100           # training stretches of a kind, and as many of none
EPOCHS, RATE, DECAY = 5, 0.4, 1e-4
SEEN = 2                 # a feature that comes up less often in training is dropped

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[A-Za-z0-9]+|[^\x00-\x7F]+|[\x20\x09-\x0D]+|[\x00-\x7F]", re.S)
TRIGGER = re.compile("[0-9@]+")
WRITTEN = re.compile(r"[(\[{](?:at|dot)[)\]}]|\x20dot\x20", re.I)
AT = {"@", "at"}
NUMERIC = frozenset(" ().-+/[]")
#: Digits, and groups of digits, that a segment of a kind may hold: wider than the base patterns ask for.
DIGITS = {1: (4, 12), 2: (13, 19), 3: (7, 15)}
GROUPS = {1: (4, 4), 2: (1, 6), 3: (1, 6)}


# ------------------------------------------------------------------ base patterns
def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From one @ to the next: the run of characters before it, if a domain follows."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, s, e) for s, e in _emails(text)]
    if not TRIGGER.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = only_digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15]
    return out


def unclear(text: str) -> bool:
    """A match that failed its test may hold personal data all the same: no example of anything."""
    return any(not 8 <= len(only_digits(m[0])) <= 15 for m in PHONE.finditer(text)) or any(
        len(only_digits(m[0])) > 19 for m in CARD.finditer(text))


# ------------------------------------------------------------------ stretches and segments
def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Parts of a text around triggers, from a blank to a blank where one is near."""
    found = [m.span() for m in TRIGGER.finditer(text)]
    if written_out(text):
        found = sorted(found + [m.span() for m in WRITTEN.finditer(text)])
    start = end = -1
    for lo, hi in found:
        if start >= 0 and lo - end <= 2 * AROUND:
            end = max(end, hi)
            continue
        if start >= 0:
            yield _widened(text, start, end)
        start, end = lo, hi
    if start >= 0:
        yield _widened(text, start, end)


def written_out(text: str) -> bool:
    """A quick look before the search for a written-out at or dot."""
    low = text.lower()
    return "dot" in low or any(x in low for x in ("at)", "at]", "at}"))


def _widened(text: str, start: int, end: int) -> tuple[int, int]:
    lo, hi = max(0, start - AROUND), min(len(text), end + AROUND)
    if lo:                                               # not in the middle of a word, if a blank is at hand
        at = text.find(" ", lo, start)
        lo = at + 1 if at >= 0 else lo
    if hi < len(text):
        at = text.rfind(" ", end, hi)
        hi = at if at >= 0 else hi
    return lo, hi


def candidates(tokens: list[str]) -> Iterator[tuple[int, int, int]]:
    """(kind, first, end) of the segments that the limits of a kind allow, in tokens."""
    n = len(tokens)
    for i, t in enumerate(tokens):
        if not (t.isascii() and (t.isdigit() or t in "+([")):
            continue
        digits = groups = dots = 0
        for j in range(i, min(n, i + LONGEST)):
            t = tokens[j]
            if t.isascii() and t.isdigit():
                digits += len(t)
                groups += 1
                if digits > 19 or groups > 6:
                    break
                for kind, (least, most) in DIGITS.items():
                    if least <= digits <= most and GROUPS[kind][0] <= groups <= GROUPS[kind][1] and (kind != 1 or dots >= 3):
                        yield kind, i, j + 1
            elif t == ".":
                dots += 1
            elif len(t) > 2 or not all(c in NUMERIC for c in t):
                break
    for at, t in enumerate(tokens):
        if t.lower() not in AT:
            continue
        if t != "@" and not (0 < at < n - 1 and tokens[at - 1] in ("(", "[", "{", " ") and tokens[at + 1] in (")", "]", "}", " ")):
            continue
        first, blanks = at, 0
        starts = []
        while first > 0 and at - first < SIDE:   # the words before it
            t = tokens[first - 1]
            if t == " " or t in "([{":
                blanks += t == " "
                if blanks > 1 or starts:
                    break
            elif not (t.isascii() and all(c in LOCAL for c in t)):
                break
            elif t.isalnum() or starts:
                starts.append(first - 1)
            first -= 1
        end, dots = at + 1, 0
        ends = []
        while end < n and end - at < SIDE:
            t = tokens[end]
            if t == "." or t.lower() == "dot":
                dots += 1
            elif t.isascii() and t.isalnum():
                if dots:
                    ends.append(end + 1)
            elif t not in " -([{)]}":
                break
            end += 1
        for i in starts:
            if tokens[i].isalnum():
                for j in ends:
                    if j - i <= LONGEST:
                        yield 0, i, j


def _class(c: str) -> str:
    return "^" if not c else "9" if "0" <= c <= "9" else "a" if c.isalpha() else "_" if c in " \t\n\r\x0b\x0c" else c


def features(tokens: list[str], kind: int, i: int, j: int) -> list[str]:
    """Features of a whole segment."""
    own = tokens[i:j]
    shape = "".join("9" if t.isdigit() and t.isascii() else "_" if t.isspace() else t.lower() if t.lower() in ("at", "dot")
                    else "a" if t.isalpha() else "x" if t.isalnum() else t[0] for t in own)
    text = "".join(own)
    groups = [t for t in own if t.isascii() and t.isdigit()]
    digits = "".join(groups)
    before = tokens[i - 1] if i else ""
    after = tokens[j] if j < len(tokens) else ""
    out = ["bias", "before=" + _class(before[-1:]), "after=" + _class(after[:1]), "first=" + _class(text[0]),
           "last=" + _class(text[-1])]
    if kind == 0:
        low = [t.lower() for t in own]
        at = next(k for k, t in enumerate(low) if t in AT)
        tail = [t for t in low[at + 1:] if t.isalnum() and t != "dot"]
        dots = sum(t in (".", "dot") for t in low[at + 1:])
        out += ["at=" + "".join(low[max(0, at - 1):at + 2]) if low[at] == "at" else "at=@",
                "dot=" + ("dot" if "dot" in low[at:] else "."), f"labels={min(len(tail), 5)}",
                f"even={len(tail) == dots + 1}", f"top={tail[-1].isalpha()}:{min(len(tail[-1]), 7)}",
                f"blanks={min(sum(t.isspace() for t in own), 6)}:{low[at] == 'at'}:{'dot' in low}",
                # a longer address around the segment
                "more=" + str((before in (".", "-", "_", "+") and i > 1) or (after in (".", "-") and j + 1 < len(tokens)
                                                                        and tokens[j + 1].isalnum()))]
    else:
        between = Counter(t for t in own if not t.isalnum())
        octets = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
        lengths = "-".join(str(len(g)) for g in groups) if len(groups) < 8 else "many"
        out += ["shape=" + shape[:24], "lengths=" + lengths, f"digits={len(digits)}",
                f"octets={octets}:{'.' in between}", f"dots={between['.']}", f"separators={len(between)}",
                f"groups={min(len(groups), 8)}", f"plus={text[0] == '+'}",
                f"open={between['('] == between[')']}:{between['['] == between[']']}",
                "more=" + str((before in (".", "-", "+", ",", "/", ":") and i > 1 and tokens[i - 2].isdigit())
                              or (after in (".", "-", ",", "/", ":") and j + 1 < len(tokens) and tokens[j + 1].isdigit()))]
        if len(digits) >= 13:
            out.append(f"luhn={luhn(digits)}:{len(digits) >= 16}:{len(groups) > 1}")
    return out


def token_features(t: str) -> list[str]:
    """Features of a token of no kind."""
    if t.isascii() and t.isdigit():
        return ["none", f"none:9:{min(len(t), 20)}"]
    return ["none:@"] if t == "@" else ["none"]


# ------------------------------------------------------------------ the model
class Model:
    """Weights of (kind, feature) and of pairs of neighbouring kinds."""

    def __init__(self, weights: dict, pairs: list[list[float]], kinds: frozenset):
        self.weights, self.pairs, self.kinds = weights, pairs, kinds

    def score(self, kind: int, found: list[str]) -> float:
        w = self.weights
        return sum(w.get((kind, f), 0.0) for f in found)

    def segments(self, tokens: list[str]) -> list[list[tuple[int, int, list[str]]]]:
        """For each end, the segments (kind, first, features) that may end there."""
        out: list[list] = [[] for _ in range(len(tokens) + 1)]
        for j, t in enumerate(tokens):
            out[j + 1].append((NONE, j, token_features(t)))
        for kind, i, j in sorted(set(candidates(tokens))):
            if kind in self.kinds:
                out[j].append((kind, i, features(tokens, kind, i, j)))
        return out

    def best(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """(kind, first, end) of the best segmentation's segments of a kind."""
        ends = self.segments(tokens)
        if all(len(e) < 2 for e in ends):
            return []
        score = [[-math.inf] * (NONE + 1) for _ in ends]
        back: list[list] = [[None] * (NONE + 1) for _ in ends]
        score[0][NONE] = 0.0                             # the text before the stretch is of no kind
        for j in range(1, len(ends)):
            for kind, i, found in ends[j]:
                own = self.score(kind, found)
                for before in range(NONE + 1):
                    s = score[i][before] + self.pairs[before][kind] + own
                    if s > score[j][kind] + 1e-12:
                        score[j][kind], back[j][kind] = s, (i, before)
        j, kind, out = len(tokens), max(range(NONE, -1, -1), key=lambda k: score[-1][k]), []
        while j:
            i, before = back[j][kind]
            if kind != NONE:
                out.append((kind, i, j))
            j, kind = i, before
        return out[::-1]

    def expected(self, ends: list) -> tuple[float, list[list[float]], dict]:
        """log Z, the expected count of each segment (by end, in order) and of each pair, over all segmentations."""
        n, k = len(ends), NONE + 1
        own = [[self.score(kind, found) for kind, _, found in e] for e in ends]
        alpha = [[-math.inf] * k for _ in range(n)]
        alpha[0][NONE] = 0.0
        for j in range(1, n):
            sums: list[list[float]] = [[] for _ in range(k)]
            for (kind, i, _), s in zip(ends[j], own[j], strict=True):
                sums[kind] += [alpha[i][b] + self.pairs[b][kind] + s for b in range(k) if alpha[i][b] > -math.inf]
            alpha[j] = [_logsum(x) for x in sums]
        beta = [[-math.inf] * k for _ in range(n)]
        beta[-1] = [0.0] * k
        gather: list[list[list[float]]] = [[[] for _ in range(k)] for _ in range(n)]
        total = _logsum([a for a in alpha[-1] if a > -math.inf])
        segment: list[list[float]] = [[] for _ in range(n)]
        pairs: dict = {}
        for j in range(n - 1, 0, -1):
            if j < n - 1:
                beta[j] = [_logsum(x) for x in gather[j]]
            for (kind, i, _), s in zip(ends[j], own[j], strict=True):
                p = 0.0
                for b in range(k):
                    if alpha[i][b] == -math.inf:
                        continue
                    step = self.pairs[b][kind] + s + beta[j][kind]
                    gather[i][b].append(step)
                    x = math.exp(alpha[i][b] + step - total)
                    pairs[b, kind] = pairs.get((b, kind), 0.0) + x
                    p += x
                segment[j].append(p)
        return total, segment, pairs


def _logsum(x: list[float]) -> float:
    if not x:
        return -math.inf
    top = max(x)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in x))


def cut(text: str) -> list[str]:
    return TOKEN.findall(text)


def places(tokens: list[str]) -> list[int]:
    out = [0]
    for t in tokens:
        out.append(out[-1] + len(t))
    return out


def rewritten(kind: int, s: str, rng: random.Random) -> str:
    """The same piece of personal data, written in another way."""
    digits = only_digits(s)
    if kind == 0:
        local, domain = s.split("@", 1)
        at, dot = rng.choice([(" at ", " dot "), ("(at)", "(dot)"), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "),
                              (" [at] ", "."), ("(at)", "."), (" @ ", "."), (" at ", ".")])
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return s.replace(".", rng.choice(["[.]", "(.)", " . "]), rng.choice([-1, 3]))
    if kind == 2:
        sep = rng.choice([".", " - ", "/", "  ", "-", " "])
        return sep.join(digits[k:k + 4] for k in range(0, len(digits), 4))
    local = digits[-10:] if len(digits) > 10 else digits
    head, mid, tail = local[:-7], local[-7:-4], local[-4:]
    form = rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "({}){}-{}", "+1.{}.{}.{}", "1-{}-{}-{}", "001 {} {} {}"])
    return form.format(head, mid, tail)


def look_alike(rng: random.Random) -> str:
    """Something with digits that is no personal data."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind = rng.randrange(12)
    if kind == 0:                                        # a long number that fails the checksum
        s = rng.choice("123456789") + d(15)
        return s if not luhn(s) else s[:-1] + str((int(s[-1]) + 1) % 10)
    if kind == 1:
        s = rng.choice("123456789") + d(15)
        s = s if not luhn(s) else s[:-1] + str((int(s[-1]) + 1) % 10)
        return rng.choice([" ", "-"]).join(s[k:k + 4] for k in range(0, 16, 4))
    if kind == 2:
        return f"{rng.randint(256, 999)}.{rng.randint(0, 999)}.{rng.randint(256, 999)}.{rng.randint(0, 99)}"
    return [f"{rng.randint(1900, 2099)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2099)}",
            f"{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", f"{rng.randint(1, 999)},{d(3)},{d(3)}",
            d(rng.randint(5, 12)), f"{rng.randint(0, 23)}:{d(2)}:{d(2)}", f"{rng.randint(1900, 2020)}-{rng.randint(1900, 2099)}",
            f"978-{rng.randint(0, 9)}-{d(2)}-{d(6)}-{rng.randint(0, 9)}", f"{rng.randint(1, 99)} at {rng.randint(1, 99)}.{rng.randint(1, 99)}"][kind - 3]


def examples(sample: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 13) -> list[tuple[list[str], set]]:
    """Token lists with their segments of a kind, from labelled stretches and rewritten copies of them."""
    rng = random.Random(seed)
    out = []

    def add(text: str, spans: list[tuple[int, int, int]]) -> None:
        tokens = cut(text)
        at = {p: i for i, p in enumerate(places(tokens))}
        if all(s in at and e in at for _, s, e in spans):
            out.append((tokens, {(k, at[s], at[e]) for k, s, e in spans}))

    for text, spans in sample:
        spans = sorted(spans, key=lambda x: x[1])
        flat = all(a[2] <= b[1] for a, b in zip(spans, spans[1:], strict=False))
        if not flat:                                     # kinds that overlap: no segmentation holds both
            continue
        add(text, spans)
        for copy in range(3 if spans else 2):
            new, at, moved = "", 0, []
            for kind, s, e in spans:
                new += text[at:s]
                if copy == 2:
                    new += look_alike(rng)
                else:
                    piece = rewritten(kind, text[s:e], rng)
                    moved.append((kind, len(new), len(new) + len(piece)))
                    new += piece
                at = e
            new += text[at:]
            if not spans:                                # among the words of a stretch without any
                words = text.split(" ")
                k = rng.randint(0, len(words))
                new = " ".join(words[:k] + [look_alike(rng)] + words[k:])
                if base_spans(new):
                    continue
            add(new, moved)
    return out


def learned(data: list[tuple[list[str], set]], epochs: int = EPOCHS, seed: int = 17) -> Model:
    """Weights by stochastic gradient ascent of the conditional log likelihood, with AdaGrad steps."""
    kinds = frozenset(k for _, spans in data for k, _, _ in spans)
    model = Model({}, [[0.0] * (NONE + 1) for _ in range(NONE + 1)], kinds)
    if not kinds:
        return model
    rows, seen = [], Counter()
    for tokens, spans in data:
        ends = model.segments(tokens)
        allowed = {(kind, i, j) for j, e in enumerate(ends) for kind, i, _ in e if kind != NONE}
        if not spans <= allowed:
            continue
        gold, free = set(spans), [True] * len(tokens)
        for _, i, j in spans:
            free[i:j] = [False] * (j - i)
        gold |= {(NONE, i, i + 1) for i, f in enumerate(free) if f}
        for kind, _, found in (x for e in ends for x in e):
            seen.update((kind, f) for f in found)
        rows.append((ends, gold, [b for _, _, b in sorted((i, j, k) for k, i, j in gold)]))
    keep = {f for f, n in seen.items() if n >= SEEN}
    model.weights = dict.fromkeys(keep, 0.0)
    sums: dict = dict.fromkeys(keep, 1e-6)
    pair_sums = [[1e-6] * (NONE + 1) for _ in range(NONE + 1)]
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(rows)
        for ends, gold, order in rows:
            _, segment, pairs = model.expected(ends)
            step: dict = {}
            for j, e in enumerate(ends):
                for (kind, i, found), p in zip(e, segment[j], strict=True):
                    g = ((kind, i, j) in gold) - p
                    if abs(g) > 1e-6:
                        for f in found:
                            step[kind, f] = step.get((kind, f), 0.0) + g
            for f, g in step.items():
                if f in keep:
                    g -= DECAY * model.weights[f]
                    sums[f] += g * g
                    model.weights[f] += RATE * g / math.sqrt(sums[f])
            for b, k in zip([NONE, *order], order, strict=False):
                pairs[b, k] = pairs.get((b, k), 0.0) - 1.0
            for (b, k), g in pairs.items():
                g = -g - DECAY * model.pairs[b][k]
                pair_sums[b][k] += g * g
                model.pairs[b][k] += RATE * g / math.sqrt(pair_sums[b][k])
    return model


# ------------------------------------------------------------------ over documents
def fit(docs: DataFrame, text_col: str = "text", per_kind: int = PER_KIND) -> Model:
    """Learn from at most ``per_kind`` stretches of each kind and of none."""
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for value in b.column("text"):
                text = value.as_py()
                base = base_spans(text)
                for lo, hi in stretches(text):
                    if hi - lo > 40 * AROUND:            # long tables teach little
                        continue
                    own = [(k, s - lo, e - lo) for k, s, e in base if s < hi and e > lo]
                    if any(s < 0 or e > hi - lo for _, s, e in own) or unclear(text[lo:hi]):
                        continue
                    out[0].append(own[0][0] if own else NONE)
                    out[1].append(xxhash.xxh3_64_intdigest(text[lo:hi]) >> 1)
                    out[2].append(text[lo:hi])
                    out[3].append(",".join(f"{k}:{s}:{e}" for k, s, e in own))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()),
                                              pa.array(out[3], pa.string())], names=["kind", "hash", "text", "spans"])

    found = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
        label, "kind int, hash long, text string, spans string")
    least = F.row_number().over(Window.partitionBy("kind").orderBy("hash", "text"))
    rows = found.withColumn("n", least).filter(F.col("n") <= per_kind).orderBy("kind", "n").collect()
    return learned(examples([(r["text"], [tuple(map(int, x.split(":"))) for x in r["spans"].split(",") if x]) for r in rows]))


def added_spans(text: str, base: list[tuple[int, int, int]], model: Model) -> list[tuple[int, int, int]]:
    """The model's spans that touch no base span."""
    out = []
    if not model.kinds:
        return out
    taken = sorted((s, e) for _, s, e in base)
    for lo, hi in stretches(text):
        tokens = cut(text[lo:hi])
        at = places(tokens)
        for kind, i, j in model.best(tokens):
            s, e = lo + at[i], lo + at[j]
            if not any(a < e and b > s for a, b in taken):
                out.append((kind, s, e))
    return out


def scan(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns with ``base`` and ``added``: array<struct(kind, start, end)>."""
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, added = [], []
            for value in b.column("_text"):
                text = value.as_py()
                own = base_spans(text)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in own])
                added.append([{"kind": k, "start": s, "end": e} for k, s, e in added_spans(text, own, shared.value)])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(base, span), pa.array(added, span)],
                                             names=[*keep, "base", "added"])

    kinds = dict(docs.dtypes)
    spans = "array<struct<kind:int,start:bigint,end:bigint>>"
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", base {spans}, added {spans}")


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    df = scan(docs, fit(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return df.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
                     F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                     joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
