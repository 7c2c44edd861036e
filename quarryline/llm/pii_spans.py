"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The patterns (email, ip, card, phone) are always reported. The field reads whole texts: a text is cut
into segments, each of which is one ordinary token or an entity of up to MAX_TOKENS tokens. An entity
is scored as a whole (number and grouping of its digits, check digit, separators, signs, what stands
beside it), and dynamic programming over all segmentations with entities of bounded length chooses
boundaries and types together. Tokens of the patterns' spans are ordinary to it, so no added span
overlaps one of them.

An entity holds an at-sign, or four digits or more between number marks. Tokens that no possible
entity covers are ordinary in every segmentation, so the programme is worked out for the stretches
that possible entities cover, each up to the ordinary token after it: the result is that of the whole
text (a test compares it with all segmentations), and time is linear in the text.

The field is trained here, by gradient steps on its likelihood, on places that the patterns label, in
the SAMPLE documents with the least hash of their id among those with a digit or "@": PLACES spans of
each of up to SPAN_CHARS code points and what stands beside them, as they are, and rewritten in ways
that the patterns miss ("name [at] host [dot] org", phones without "+", cards with points, defanged
addresses); TRAIN_WINDOWS / 2 of them are learnt from. Numbers that fail a check, and made-up dates,
amounts and order numbers, are its ordinary text. Without a span in the sample it is trained on
made-up ones alone.

Defined results: a null text is empty; rows are independent, so repeated rows, extra columns and
empty tables need nothing special; time grows linearly with a text, and no text is too long.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import vectors as V
from quarryline.llm.common import materialize, read_table, ship

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, MAX_DIGITS = 30, 19
#: Documents that places are taken from, places of each, windows that the field is trained on, rounds.
SAMPLE, PLACES, TRAIN_WINDOWS, EPOCHS = 1000, 3, 320, 6
#: Code points beside a place that a training window takes in, and of the place itself at most.
BESIDE, SPAN_CHARS = 40, 200

_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def small(part: str) -> bool:
    """At most 255, without reading long numbers."""
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and without overlap in a kind.

    Written so that every kind takes linear time: an address is widened to the left from its "@"
    down to the last match, dotted numbers are taken as whole runs and cut in fours.
    """
    found = []
    done = 0
    for m in _AT_DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, 0, m.end()))
            done = m.end()
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(map(small, four)):
                found.append((at, 1, at + size))
            at += size + 1
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_DIGIT.sub("", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---- the field

_NUMBERS = re.compile(r"[0-9][0-9\x20()\[\].+-]*")
_MARKS = frozenset(" ()[].+-")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.DOTALL)
_AT = re.compile(r"@|[\[(]\x20?at\x20?[\])]", re.IGNORECASE)
_DOT = re.compile(r"\.|[\[(]\x20?dot\x20?[\])]", re.IGNORECASE)
_GROUPS = re.compile(r"[0-9]+")
_LETTER = re.compile(r"[^\W\d_]")
_NO_NUMBER = re.compile(r"[^0-9\x20()\[\].+-]")


def _side(c: str) -> str:
    return "end" if not c else "letter" if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else "quote" if c in "\"'" else "mark"


def span_features(text: str, a: int, b: int) -> list[str] | None:
    """What a segment looks like as a whole; None if it can't be an entity."""
    s = text[a:b]
    out = ["any", "before " + _side(text[a - 1 : a]), "after " + _side(text[b : b + 1])]
    at = _AT.findall(s)
    if at:
        if len(at) > 1:
            return None
        local, _, host = s.partition(at[0])
        labels = [x.strip() for x in _DOT.split(host)]
        out += ["at", "at " + ("sign" if at[0] == "@" else "word")]
        if not local.strip() or re.search(r"\s", local.strip()) or any(not re.fullmatch(r"[A-Za-z0-9-]+", x) for x in labels) or len(labels) < 2:
            return None
        tld = labels[-1]
        return out + [f"labels {min(len(labels), 4)}", f"tld {tld.isalpha()} {min(len(tld), 5)}", f"spaces {min(s.count(' '), 5)}"]
    groups = _GROUPS.findall(s)
    n = sum(map(len, groups))
    if n < 4 or n > 19 or _NO_NUMBER.search(s) or (n < 7 and "." not in s):
        return None
    marks = sorted(set(s) - set("0123456789"))
    out += [f"digits {n}", "marks " + "".join(marks), f"groups {min(len(groups), 6)}", "first " + ("+" if s[0] == "+" else "(" if s[0] == "(" else "digit"), f"last {min(len(groups[-1]), 5)}"]
    shape = "-".join(map(str, map(len, groups)))
    if len(shape) < 12:
        out.append("shape " + shape)
    if len(groups) == 4:
        byte = all(map(small, groups)) and max(map(len, groups)) <= 3
        out.append(f"bytes {byte} {_DIGIT.findall(s)[0].strip() if _DIGIT.findall(s) else ''}")
    if 13 <= n <= 19:
        out.append(f"check {luhn(''.join(groups))}")
    return out


def _class(c: str) -> int:
    """What kind of token a code point belongs to; those of the last kind are tokens of their own."""
    return 0 if "0" <= c <= "9" else 1 if c.isalnum() and not c.isdecimal() else 2 if c.isspace() else 3


def _token_start(text: str, end: int) -> int:
    """Where the token that ends at end begins."""
    kind, at = _class(text[end - 1]), end - 1
    while kind < 3 and at > 0 and _class(text[at - 1]) == kind:
        at -= 1
    return at


def stretches(text: str) -> list[list[int]]:
    """[begin, end) of the parts of a text that hold every possible entity, and the token after each; merged."""
    found = []
    done = 0
    for m in _NUMBERS.finditer(text):
        if sum(map(len, _GROUPS.findall(m.group()))) >= 4:
            begin, end = m.start(), m.end()
            while begin > done and text[begin - 1] in _MARKS:
                begin -= 1
            while text[begin] not in "+(0123456789":
                begin += 1
            while not "0" <= text[end - 1] <= "9":
                end -= 1
            found.append([begin, end])
        done = m.end()
    for m in _AT.finditer(text):
        begin = m.start()
        tokens = 0
        while begin > 0 and tokens < MAX_TOKENS:
            before = _token_start(text, begin)
            if text[before].isspace() and tokens:
                break
            begin, tokens = before, tokens + 1
        end = m.end()
        for _ in range(MAX_TOKENS):
            if (t := _TOKEN.match(text, end)) is None:
                break
            end = t.end()
        found.append([begin, end])
    merged: list[list[int]] = []
    for begin, end in sorted(found):
        after = _TOKEN.match(text, end)
        end = after.end() if after else end
        if merged and begin <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([begin, end])
    return merged


def segments(text: str, begin: int, end: int, blocked: list[tuple[int, int]]) -> tuple[list[int], list[tuple[int, int, list[str]]]]:
    """Token borders of a part, and its possible entities (first token, end token, features); blocked: ordered spans they keep clear of."""
    borders = [begin, *(m.end() for m in _TOKEN.finditer(text, begin, end))]
    n, found = len(borders) - 1, []
    free = [True] * n
    for a, b in blocked:
        for k in range(max(bisect.bisect_right(borders, a) - 1, 0), n):
            if borders[k] >= b:
                break
            free[k] = False
    ats = [(m.start(), m.end()) for m in _AT.finditer(text, begin, end)]
    nth = 0
    for i in range(n):
        start = borders[i]
        c = text[start]
        if not free[i] or not (c.isalnum() or c in "+("):
            continue
        while nth < len(ats) and ats[nth][0] < start:
            nth += 1
        at = ats[nth] if nth < len(ats) and not re.search(r"\s", text[start : ats[nth][0]].rstrip()) else None
        beyond = ats[nth + 1][1] if at and nth + 1 < len(ats) else end + 1
        number, digits = True, 0
        for j in range(i + 1, min(i + MAX_TOKENS, n) + 1):
            if not free[j - 1] or borders[j] >= beyond:
                break
            piece = text[borders[j - 1] : borders[j]]
            if number:
                number = not _NO_NUMBER.search(piece)
                digits += len(piece) if "0" <= piece[0] <= "9" else 0
                number = number and digits <= MAX_DIGITS
            if not number and not at:
                break
            if piece[-1].isalnum() and (number or (at and borders[j] >= at[1])):
                f = span_features(text, start, borders[j])
                if f is not None:
                    found.append((i, j, f))
    return borders, found


class Field:
    """Weights: of an entity's features by kind, and of a segment's kind after another's (the last is ordinary)."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, follow: np.ndarray | None = None):
        self.weights = weights or {}
        self.follow = np.zeros((5, 5)) if follow is None else follow

    def scores(self, found) -> np.ndarray:
        none, known, out = np.zeros(4), {}, np.zeros((len(found), 4))
        for k, (_, _, fs) in enumerate(found):
            look = tuple(fs)
            if look not in known:
                known[look] = sum((self.weights.get(f, none) for f in fs), none)
            out[k] = known[look]
        return out

    def decode(self, n: int, found, scores: np.ndarray) -> list[tuple[int, int, int]]:
        """(first token, end token, kind) of the entities of the best segmentation of n tokens."""
        ending: dict[int, list[int]] = {}
        for k, (_, j, _) in enumerate(found):
            ending.setdefault(j, []).append(k)
        best = [[-math.inf] * 5 for _ in range(n + 1)]
        back: list[list] = [[None] * 5 for _ in range(n + 1)]
        best[0][4] = 0.0
        follow = self.follow.tolist()
        values = scores.tolist()
        into: list = [None] * (n + 1)  # of each border: the best way to begin a segment of each kind there
        for j in range(1, n + 1):
            before = best[j - 1]
            into[j - 1] = [max((before[prev] + follow[prev][kind], -prev) for prev in range(5)) for kind in range(5)]
            best[j][4], prev = into[j - 1][4]
            back[j][4] = (j - 1, -prev)
            for k in ending.get(j, ()):
                i = found[k][0]
                for kind in range(4):
                    v = into[i][kind][0] + values[k][kind]
                    if v > best[j][kind]:
                        best[j][kind], back[j][kind] = v, (i, -into[i][kind][1])
        out, j, kind = [], n, max(range(5), key=lambda y: best[n][y])
        while j:
            i, prev = back[j][kind]
            if kind < 4:
                out.append((i, j, kind))
            j, kind = i, prev
        return out[::-1]

    def learn(self, examples, epochs: int = EPOCHS, rate: float = 0.4) -> None:
        """examples: (number of tokens, possible entities, {index of an entity: kind}); steps on the likelihood."""
        grown: dict[str, np.ndarray] = {}
        followed = np.full((5, 5), 1e-6)
        for _ in range(epochs):
            for n, found, gold in examples:
                s = self.scores(found)
                starting: dict[int, list[int]] = {}
                ending: dict[int, list[int]] = {}
                for k, (i, j, _) in enumerate(found):
                    starting.setdefault(i, []).append(k)
                    ending.setdefault(j, []).append(k)
                fore = np.full((n + 1, 5), -1e9)
                fore[0, 4] = 0
                for j in range(1, n + 1):
                    into = np.full((5,), -1e9)
                    into[4] = np.logaddexp.reduce(fore[j - 1] + self.follow[:, 4])
                    for k in ending.get(j, ()):
                        into[:4] = np.logaddexp(into[:4], np.logaddexp.reduce(fore[found[k][0]][:, None] + self.follow[:, :4], axis=0) + s[k])
                    fore[j] = into
                hind = np.full((n + 1, 5), -1e9)
                hind[n] = 0
                for i in range(n - 1, -1, -1):
                    out = self.follow[:, 4] + hind[i + 1, 4]
                    for k in starting.get(i, ()):
                        out = np.logaddexp(out, np.logaddexp.reduce(self.follow[:, :4] + s[k] + hind[found[k][1], :4], axis=1))
                    hind[i] = out
                total = np.logaddexp.reduce(fore[n])
                change = np.zeros((5, 5))
                at = {found[k][0]: (k, kind) for k, kind in gold.items()}
                i, prev = 0, 4
                while i < n:  # the right segmentation
                    k, kind = at.get(i, (None, 4))
                    change[prev, kind] += 1
                    i, prev = (i + 1 if k is None else found[k][1]), kind
                for i in range(n):
                    change[:, 4] -= np.exp(fore[i] + self.follow[:, 4] + hind[i + 1, 4] - total)
                for k, (i, j, fs) in enumerate(found):
                    pair = np.exp(fore[i][:, None] + self.follow[:, :4] + s[k] + hind[j, :4] - total)
                    change[:, :4] -= pair
                    step = -pair.sum(axis=0)
                    if k in gold:
                        step[gold[k]] += 1
                    for f in fs:
                        g = grown.setdefault(f, np.full(4, 1e-6))
                        g += step * step
                        w = self.weights.setdefault(f, np.zeros(4))
                        w += rate * step / np.sqrt(g + 0.1) - 1e-4 * w
                followed += change * change
                self.follow += rate * change / np.sqrt(followed + 0.1)


# ---- what it learns from


def _variants(kind: int, span: str, rng: random.Random) -> str:
    """The same thing as people write it past the patterns."""
    digits = _DIGIT.sub("", span)
    if kind == 0:
        local, host = span.rsplit("@", 1)
        at, dot = rng.choice([(" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "."), (" (at) ", "."), (" @ ", "."), ("(at)", "(dot)")])
        return local + at + host.replace(".", dot)
    if kind == 1:
        return span.replace(".", "[.]") if rng.random() < 0.6 else span.replace(".", " . ")
    if kind == 2:
        mark = rng.choice([".", "  ", " - ", "/"]) if len(digits) == 16 else "."
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4)) if mark != "/" else ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    tail = (digits + "5550100")[-10:]
    return rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "1-{}-{}-{}", "({}) {} {}"]).format(tail[:3], tail[3:6], tail[6:])


def _made_up(rng: random.Random) -> tuple[int, str]:
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind = rng.randrange(4)
    if kind == 0:
        return 0, f"{rng.choice(['ann', 'lee', 'info', 'k.west'])}.{number(2)}@mail{number(1)}.example.{rng.choice(['com', 'org', 'net'])}"
    if kind == 1:
        return 1, ".".join(str(rng.randrange(1, 255)) for _ in range(4))
    if kind == 3:
        return 3, f"+1 ({number(3)}) 555-{number(4)}"
    body = number(15)
    return 2, next(body + c for c in "0123456789" if luhn(body + c))


def _ordinary(rng: random.Random) -> str:
    """Numbers and signs that are nobody's data."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    bad = number(16)
    while luhn(bad):
        bad = number(16)
    grouped = " ".join(bad[i : i + 4] for i in range(0, 16, 4))
    return rng.choice([
        bad, bad, grouped, grouped.replace(" ", "."), number(7), number(8), number(9), number(10), number(11), number(12), number(13), number(18),
        f"{rng.randrange(1900, 2030)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}", f"{rng.randrange(10, 29)}.{rng.randrange(10, 13)}.{rng.randrange(1900, 2030)}",
        f"{number(3)} {number(3)} {number(3)}", f"{number(7)}.{number(2)}", f"{rng.randrange(1, 9)}.{number(2)}.{number(4)}", f"{rng.randrange(1900, 2030)}-{rng.randrange(1900, 2030)}",
        f"{rng.randrange(256, 999)}.{number(3)}.{number(3)}.{number(3)}", f"{number(4)} {number(4)}", f"{number(1)} {number(2)} {number(1)} {number(3)} {number(2)}", "@ noon", "at @ here", f"{number(5)}-{number(4)}",
    ])


def _places(text: str) -> list[tuple[str, int, str, str]]:
    """(left, kind, span, right) of a text's first short spans; of a text without one a piece from its middle (kind -1)."""
    spans = pattern_spans(text)
    if not spans:
        middle = len(text) // 2
        return [("", -1, text[middle : middle + 2 * BESIDE], "")] if len(text) > 4 * BESIDE else []
    short = [x for x in spans if x[2] - x[0] <= SPAN_CHARS][:PLACES]
    return [(text[max(0, a - BESIDE) : a], kind, text[a:b], text[b : b + BESIDE]) for a, kind, b in short]


def _examples(taken: list[tuple[str, int, str, str]], rng: random.Random) -> list:
    places = [p for p in taken if p[1] >= 0]
    plain = [p[2] for p in taken if p[1] < 0]
    rng.shuffle(places)
    places = places[: TRAIN_WINDOWS // 2]
    beside = [p[:BESIDE] for p in plain] or ["of the and "]
    for _ in range(TRAIN_WINDOWS // 4):
        kind, span = _made_up(rng)
        places.append((rng.choice(beside) + " ", kind, span, " " + rng.choice(beside)))
    made = []

    def add(left: str, middle: str, right: str, kind: int | None) -> None:
        if _TOKEN.match(left[-1:] or " ") and pattern_spans(left) + pattern_spans(right):
            left, right = "", ""
        text = left + middle + right
        borders, found = segments(text, 0, len(text), [])
        gold = {}
        if kind is not None:
            a, b = len(left), len(left) + len(middle)
            gold = {k: kind for k, (i, j, _) in enumerate(found) if borders[i] == a and borders[j] == b}
            if not gold:
                return
        if found:
            made.append((len(borders) - 1, found, gold))

    for left, kind, span, right in places:
        add(left, span, right, kind)
        add(left, _variants(kind, span, rng), right, kind)
    for _ in range(TRAIN_WINDOWS):
        left, right = rng.choice(beside), rng.choice(beside)
        add(left + " ", _ordinary(rng), rng.choice([" ", ". ", ", "]) + right, None)
    rng.shuffle(made)
    return made


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Field:
    """A field from the SAMPLE documents with the least hash of their id, of those with a digit or "@"."""
    ship(docs.sparkSession)
    rows = docs.select(F.xxhash64(key).alias("h"), F.col(text).alias("t"))
    ids = rows.filter(F.col("t").rlike("[0-9@]")).select("h").orderBy("h").limit(SAMPLE)
    ids = F.broadcast(materialize(ids.distinct(), "sample"))  # SAMPLE rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                found = _places(t.as_py() or "")
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int32() if k == 1 else pa.string()) for k in range(4)], names=["l", "kind", "span", "r"])

    # short pieces only, PLACES for each document (a document's copies, as equal rows, are one)
    taken = rows.join(ids, "h").select("t").mapInArrow(run, "l string, kind int, span string, r string").distinct()
    taken = taken.orderBy("span", "kind", "l", "r").limit(SAMPLE * PLACES).collect()
    field = Field()
    field.learn(_examples([tuple(r) for r in taken], random.Random(5)))
    return field


# ---- whole texts


def added_spans(text: str, field: Field, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the field adds to the patterns'."""
    cover: list[tuple[int, int]] = []  # apart and in order
    for a, _, b in sorted(base):
        if cover and a <= cover[-1][1]:
            cover[-1] = (cover[-1][0], max(b, cover[-1][1]))
        else:
            cover.append((a, b))
    ends = [b for _, b in cover]
    out = []
    for begin, end in stretches(text):
        near = bisect.bisect_right(ends, begin)
        upto = near
        while upto < len(cover) and cover[upto][0] < end:
            upto += 1
        borders, found = segments(text, begin, end, cover[near:upto])
        if found:
            for i, j, kind in field.decode(len(borders) - 1, found, field.scores(found)):
                out.append((borders[i], kind, borders[j]))
    return out


def _joined(spans) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


_EMPTY = hashlib.sha256(b"").hexdigest()
_MAYBE = np.zeros(256, bool)
_MAYBE[[*range(48, 58), 64, 91, 40]] = True


def find(docs: DataFrame, field: Field, keys: list[str], text: str = "text") -> DataFrame:
    """keys, n_email, n_ip, n_card, n_phone (of the patterns), base_sha256, spans, n_added."""
    ship(docs.sparkSession)
    chosen = docs.select(*keys, F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    weights, follow = field.weights, field.follow

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(weights, follow)
        for batch in batches:
            column = batch.column("__text")
            for first, n, data, offsets in V.slices(column):
                # a text without a digit, "@" or bracket has nothing to find
                seen = np.concatenate([[0], np.cumsum(_MAYBE[data])])
                counts, base_sha, spans, added = np.zeros((4, n), np.int64), [_EMPTY] * n, [""] * n, np.zeros(n, np.int64)
                for row in np.flatnonzero(seen[offsets[1:]] > seen[offsets[:-1]]).tolist():
                    t = column[first + row].as_py()
                    base = pattern_spans(t)
                    more = added_spans(t, model, base)
                    for _, k, _ in base:
                        counts[k, row] += 1
                    if base:
                        base_sha[row] = hashlib.sha256(_joined(base).encode()).hexdigest()
                    if base or more:
                        spans[row] = _joined(sorted(base + more))
                    added[row] = len(more)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, n) for c in keys), *(pa.array(c) for c in counts), pa.array(base_sha, pa.string()), pa.array(spans, pa.string()), pa.array(added)],
                    names=[*keys, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
                )

    return chosen.mapInArrow(run, f"{fields}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, train(docs), ["doc_id"])
