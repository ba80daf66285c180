"""Personal data in whole texts: fixed patterns, and a semi-Markov conditional random field that adds to them.

The field scores whole segments, not single words: the grouping and number of digits, checksums, ranges,
separators, spelled-out signs and the word before. Candidate segments are proposed loosely around digits and
at-signs and have a bounded length, so the best set of segments that do not overlap, with its
boundaries and kinds, comes from one dynamic program over the segments' ends. What stands outside of
segments scores 0. Found segments that touch a span of the patterns are left out: those spans stay as they are.

The weights are trained here by the likelihood of whole segmentations (forward and backward sums over the same
candidates). Training texts are passages of the given table, a bounded sample, into which made-up
entities are put: as the patterns know them, written in other ways, and numbers that are no personal data.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.batches import on_workers, pieces_of

# The kinds in their order, and their patterns. Possessive forms find the same and do not backtrack.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Bounds of a segment: digits and groups of digits, and labels of a domain.
LEAST_DIGITS, MOST_DIGITS, MOST_GROUPS, MOST_LABELS = 7, 19, 8, 5
#: Passages of the table that training uses, their length, and made-up sequences per passage.
PASSAGES, PASSAGE_CHARS, COPIES = 300, 240, 4
ROUNDS, STEP, PENALTY = 60, 0.4, 0.02
#: Scores a worker remembers.
HELD_SCORES = 200_000

GROUPS = re.compile(r"[0-9]++(?:[\x20 ().–/\[\]-]{1,3}[0-9]++)*")
GROUP = re.compile(r"[0-9]+")
SAME = str.maketrans(" –", " -")
AT = re.compile(r"\s?@\s?|\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\sat\s", re.IGNORECASE)
AT_HINTS = ("@", "[at", "(at", "{at", "<at", " dot ")
LEFT = re.compile(r"[\w.%+-]{1,64}$")
DOT = r"(?:\.|\s\.\s|\s?[\[({<]\s?(?:\.|dot)\s?[\])}>]\s?|\sdot\s)"
RIGHT = re.compile(rf"[\w-]{{1,63}}(?:{DOT}[\w-]{{1,63}}){{1,{MOST_LABELS - 1}}}", re.IGNORECASE)
DOTS = re.compile(DOT, re.IGNORECASE)
WORD_BEFORE = re.compile(r"([^\W\d_]{1,12})[\s:.#=]{0,3}$")


class Candidate(NamedTuple):
    start: int
    end: int
    kind: str
    #: What the segment shows; equal signs score alike.
    signs: tuple


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def is_octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the patterns find, by start, then kind."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(map(is_octet, m.group().split(".")))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def surroundings(text: str, start: int, end: int) -> tuple[str, str, str]:
    """The word before, and the characters at both sides as classes."""
    word = WORD_BEFORE.search(text[max(0, start - 16) : start])
    return word[1].lower() if word else "", side(text[start - 1 : start]), side(text[end : end + 1])


def side(c: str) -> str:
    return "edge" if not c else "blank" if c.isspace() else "mark" if not c.isalnum() and c != "_" else "word"


def number_candidates(text: str) -> Iterator[Candidate]:
    """Neighbouring groups of digits, with a plus sign or an open bracket that belongs to them."""
    for stretch in GROUPS.finditer(text):
        if stretch.end() - stretch.start() < LEAST_DIGITS:
            continue
        groups = [(stretch.start() + m.start(), stretch.start() + m.end()) for m in GROUP.finditer(stretch.group())]
        for a, (first, _) in enumerate(groups):
            n = 0
            for b in range(a, min(a + MOST_GROUPS, len(groups))):
                last = groups[b][1]
                n += last - groups[b][0]
                if n > MOST_DIGITS:
                    break
                if n < LEAST_DIGITS:
                    continue
                start, inner = first, text[first:last]
                if inner.count(")") > inner.count("("):
                    if text[start - 1 : start] != "(":
                        continue
                    start -= 1
                if start and text[start - 1] == "+":
                    start -= 1
                word, before, after = surroundings(text, start, last)
                if before == "word" or after == "word" or inner.count("(") > inner.count(")") + (start < first and text[first - 1] != "("):
                    continue
                parts = [text[x:y] for x, y in groups[a : b + 1]]
                shape = GROUP.sub(lambda g: str(min(len(g.group()), 19)), text[start:last].translate(SAME))
                digits = "".join(parts)
                marks = (12 <= n and luhn(digits), len(parts) == 4 and all(map(is_octet, parts)))
                for kind in KINDS[1:]:
                    yield Candidate(start, last, kind, ("number", shape, n, *marks, word, before, after))


def email_candidates(text: str) -> Iterator[Candidate]:
    """A name, an at-sign in any spelling, and labels joined by dots in any spelling, with every sensible start and end."""
    low = text.lower()
    if not any(h in low for h in AT_HINTS):
        return
    for at in AT.finditer(text):
        name, labels = LEFT.search(text[max(0, at.start() - 64) : at.start()]), RIGHT.match(text, at.end())
        sign = at.group().lower()
        sign = "word" if sign.strip() == "at" else "bracket" if sign.strip() not in "@" else "spaced" if sign != "@" else "@"
        if not name or not labels or (sign == "word" and " dot " not in labels.group().lower()):
            continue
        origin = at.start() - len(name.group())
        starts = [origin, *[origin + m.end() for m in list(re.finditer(r"\.", name.group()))[-2:] if m.end() < len(name.group())]]
        dots = list(DOTS.finditer(text, labels.start(), labels.end()))
        for i, dot in enumerate(dots):
            end = dots[i + 1].start() if i + 1 < len(dots) else labels.end()
            kinds = "".join(sorted({"." if d.group() == "." else "w" if "dot" in d.group().lower() else "s" for d in dots[: i + 1]}))
            top = text[dot.end() : end].lower()
            for start in starts:
                word, before, after = surroundings(text, start, end)
                if after != "word":
                    yield Candidate(start, end, "email", ("email", sign, kinds, i + 1, top if len(top) < 7 and top.isalpha() else "?", start == origin, word, before, after))


def candidates(text: str) -> list[Candidate]:
    found = list(number_candidates(text)) if DIGIT.search(text) else []
    return sorted([*found, *email_candidates(text)], key=lambda c: (c.end, c.start, KINDS.index(c.kind)))


def features(kind: str, signs: tuple) -> list[str]:
    """Names of what holds for a segment, each with its kind."""
    if signs[0] == "email":
        _, sign, dots, labels, top, whole, word, before, after = signs
        own = [f"at {sign}", f"dots {dots}", f"at {sign} dots {dots}", f"labels {min(labels, 3)}", f"top {top}", f"top of {len(top)}", f"whole {whole}"]
    else:
        _, shape, n, checks, octets, word, before, after = signs
        form = GROUP.sub("d", shape)
        sizes = GROUP.findall(shape)
        own = [
            f"shape {shape}", f"form {form}", f"digits {n}", f"groups {len(sizes)}", f"first {sizes[0]}", f"last {sizes[-1]}", f"checks {checks}",
            f"octets {octets}", f"checks {checks} digits {n}", f"octets {octets} form {form}", f"separators {''.join(sorted(set(GROUP.sub('', shape))))}",
        ]
    return [f"{kind} {f}" for f in ("bias", *own, f"after {word}", f"left {before}", f"right {after}")]


def best_segments(found: list[Candidate], scores: list[float]) -> list[Candidate]:
    """The segments of the best segmentation: they do not overlap, and their scores add up to the most."""
    if not any(s > 0 for s in scores):
        return []
    places = sorted({0, *[c.start for c in found], *[c.end for c in found]})
    number = {p: i for i, p in enumerate(places)}
    best, came = [0.0] * len(places), [None] * len(places)
    at = 0
    for i in range(1, len(places)):
        best[i] = best[i - 1]
        while at < len(found) and found[at].end == places[i]:
            total = best[number[found[at].start]] + scores[at]
            if total > best[i]:
                best[i], came[i] = total, found[at]
            at += 1
    out, i = [], len(places) - 1
    while i > 0:
        if came[i]:
            out.append(came[i])
            i = number[came[i].start]
        else:
            i -= 1
    return out[::-1]


def marginals(ends: np.ndarray, starts: np.ndarray, n_places: int, scores: np.ndarray) -> tuple[np.ndarray, float]:
    """Probability of each candidate under the field, and the logarithm of the sum over all segmentations. Candidates come by end; places are numbered."""
    forward, backward = [0.0] * n_places, [0.0] * n_places
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        by_end.setdefault(b, []).append(k)
        by_start.setdefault(a, []).append(k)

    def total(values: list[float]) -> float:
        top = max(values)
        return top + math.log(sum(math.exp(v - top) for v in values))

    for i in range(1, n_places):
        forward[i] = total([forward[i - 1], *[forward[starts[k]] + scores[k] for k in by_end.get(i, ())]])
    for i in range(n_places - 2, -1, -1):
        backward[i] = total([backward[i + 1], *[backward[ends[k]] + scores[k] for k in by_start.get(i, ())]])
    whole = forward[-1]
    f, b = np.array(forward), np.array(backward)
    return np.exp(f[starts] + scores + b[ends] - whole), whole


def made_up(draw: random.Random) -> tuple[str, str | None, str]:
    """(text, kind or None, a word that may stand before) of one entity or of a number that is none."""
    def digits(n: int) -> str:
        return str(draw.randrange(1, 10)) + "".join(draw.choices("0123456789", k=n - 1))

    def card(n: int) -> str:
        head = digits(n - 1)
        return next(head + c for c in "0123456789" if luhn(head + c))

    def grouped(s: str, sep: str) -> str:
        return sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    what = draw.randrange(12)
    if what < 2:
        name = draw.choice(["", draw.choice(["anna", "j", "info", "max", "sales"]) + draw.choice([".", "_", ""])]) + draw.choice(["smith", "team", digits(2), "office" + digits(1)])
        at = draw.choice(["@", "@", " @ ", "[at]", " [at] ", "(at)", " (at) ", " at "])
        dot = " dot " if at == " at " else draw.choice([".", ".", "[dot]", " [dot] ", "(dot)", " dot "]) if at != "@" else draw.choice([".", ".", "[.]"])
        labels = [draw.choice(["mail", "example", "host" + digits(1)]), *draw.choice([[], ["co"], ["example"]]), draw.choice(["com", "org", "net", "de", "fr", "es", "io", "uk"])]
        return f"{name}{at}{dot.join(labels)}", "email", draw.choice(["email", "mail", "contact", "write"])
    if what < 4:
        parts = [str(draw.randrange(256)) for _ in range(4)]
        return draw.choice([".", ".", "[.]", " . "]).join(parts), "ip", draw.choice(["ip", "host", "address", "from"])
    if what < 6:
        s = card(draw.choice([16, 16, 15, 13, 19]))
        return draw.choice([s, grouped(s, " "), grouped(s, "-"), grouped(s, "."), grouped(s, "/"), grouped(s, "–"), grouped(s, " ")]), "card", draw.choice(["card", "visa", "credit", "pay"])
    if what < 8:
        a, b, c, land = digits(3), digits(3), digits(4), draw.choice(["1", "44", "49", "33"])
        forms = [f"+{land} ({a}) {b}-{c}", f"+{land} {a} {b} {c}", f"+{land}-{a}-{b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{land} {a} {b} {c}", f"0{a} {b} {c}", f"+{land}/{a}/{b}{c}"]
        return draw.choice(forms), "phone", draw.choice(["phone", "tel", "call", "mobile", "fax"])
    year, month, day = str(draw.randrange(1900, 2035)), f"{draw.randrange(1, 13):02}", f"{draw.randrange(1, 29):02}"
    bad = card(16)
    bad = bad[:-1] + str((int(bad[-1]) + draw.randrange(1, 10)) % 10)
    far = ".".join(str(draw.randrange(100, 999)) for _ in range(3)) + f".{draw.randrange(300, 999)}"
    none = [
        f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{day}/{month}/{year}", f"{year}-{month}-{day} {day}", f"{year}-{int(year) + 5} {year}-{int(year) + 9}", digits(draw.randrange(7, 12)), digits(draw.randrange(12, 20)),
        f"{digits(2)}.{digits(6)}", f"{digits(1)}.{digits(7)}", f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", bad, grouped(bad, " "), grouped(bad, "-"), far, " ".join(digits(draw.randrange(1, 4)) for _ in range(6)),
        " ".join(digits(4) for _ in range(draw.randrange(2, 5))), f"{digits(3)}.{digits(3)}.{digits(3)}", f"{digits(1)}.{digits(2)}.{digits(4)}.{digits(2)}", f"{digits(4)}-{digits(4)}", f"{digits(3)} {digits(3)} {digits(3)}",
        f"{draw.choice(['look', 'meet'])} at {draw.choice(['noon', 'home'])}. {draw.choice(['then', 'it'])}", f"{draw.choice(['prices', 'all'])} @ {draw.choice(['home', 'ten'])}. And", f"one at dot {draw.choice(['plots', 'com'])}", "see (at) home . now",
    ]
    return draw.choice(none), None, draw.choice(["version", "isbn", "date", "order", "ref", "page"])


def training_texts(passages: list[str], seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans) with made-up entities put between the words of passages; what the patterns find in a passage itself is a span too."""
    draw, out = random.Random(seed), []
    for passage in passages or ["words of a text that is not there, and more of them"]:
        for _ in range(COPIES):
            words = passage.split(" ")
            cuts = sorted(draw.sample(range(len(words) + 1), min(2, len(words) + 1)))
            text, spans, at = "", [], 0
            for cut in cuts:
                entity, kind, word = made_up(draw)
                text += " ".join(words[at:cut]) + (" " if cut > at else "") + (f"{word} " if draw.random() < 0.3 else "")
                if kind:
                    spans.append((len(text), len(text) + len(entity), kind))
                text += entity + draw.choice([" ", " ", ", ", ". ", "\n"])
                at = cut
            text += " ".join(words[at:])
            spans += [s for s in base_spans(text) if not any(s[0] < b and a < s[1] for a, b, _ in spans)]
            out.append((text, spans))
    return out


def trained(examples: list[tuple[str, list[tuple[int, int, str]]]]) -> dict[str, float]:
    """Weights of the features that occur twice, by the likelihood of the examples' segmentations with a quadratic penalty."""
    rows, seen = [], Counter()
    for text, spans in examples:
        found = candidates(text)
        if found:
            names = [features(c.kind, c.signs) for c in found]
            seen.update(f for own in names for f in own)
            rows.append((found, names, {(a, b, k) for a, b, k in spans}))
    number = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n > 1))}
    if not number:
        return {}
    given, sequences, flat, owner = np.zeros(len(number)), [], [], []
    first = 0
    for found, names, spans in rows:
        places = {p: i for i, p in enumerate(sorted({0, *[c.start for c in found], *[c.end for c in found]}))}
        sequences.append((first, first + len(found), np.array([places[c.end] for c in found]), np.array([places[c.start] for c in found]), len(places)))
        for k, (c, own) in enumerate(zip(found, names)):
            ids = [number[f] for f in own if f in number]
            flat += ids
            owner += [first + k] * len(ids)
            if (c.start, c.end, c.kind) in spans:
                given[ids] += 1
        first += len(found)
    flat, owner = np.array(flat), np.array(owner)
    weights, squares = np.zeros(len(number)), np.full(len(number), 1e-8)
    for _ in range(ROUNDS):
        scores = np.bincount(owner, weights[flat], first)
        chance = np.zeros(first)
        for a, b, ends, starts, n in sequences:
            chance[a:b] = marginals(ends, starts, n, scores[a:b])[0]
        slope = given - np.bincount(flat, chance[owner], len(number)) - PENALTY * weights
        squares += slope**2
        weights += STEP * slope / np.sqrt(squares)
    return {f: float(weights[i]) for f, i in number.items()}


class Field:
    """The trained field with a bounded memory of scores."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.known = weights, {}

    def score(self, c: Candidate) -> float:
        key = (c.kind, c.signs)
        if key not in self.known:
            if len(self.known) >= HELD_SCORES:
                self.known.clear()
            self.known[key] = sum(self.weights.get(f, 0.0) for f in features(c.kind, c.signs))
        return self.known[key]

    def segments(self, text: str) -> list[tuple[int, int, str]]:
        found = candidates(text)
        return [c[:3] for c in best_segments(found, [self.score(c) for c in found])] if found else []


def spans_of(text: str, field: Field) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Spans of the patterns, and those that the field adds."""
    base = base_spans(text)
    covered: list[list[int]] = []
    for a, b, _ in base:
        if covered and a < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    added, at = [], 0
    for a, b, kind in field.segments(text):
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        if at == len(covered) or covered[at][0] >= b:
            added.append((a, b, kind))
    return base, added


def fitted(docs: DataFrame, passages: int = PASSAGES, seed: int = 12, id_column: str = "doc_id", text: str = "text") -> dict[str, float]:
    """Weights trained on at most ``passages`` passages of the table, chosen by a hash of id and text; that many short texts reach the driver."""
    given = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    mark = F.xxhash64(F.col("id"), F.char_length("text"), F.lit(seed))
    place = F.pmod(mark, F.greatest(F.char_length("text") - PASSAGE_CHARS, F.lit(1))).cast("int") + 1
    rows = given.select(mark.alias("mark"), F.substring(F.col("text"), place, PASSAGE_CHARS).alias("passage")).orderBy("mark", "passage").limit(passages).collect()
    return trained(training_texts([r["passage"] for r in rows], seed))


def personal_data(docs: DataFrame, weights: dict[str, float] | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``spans array<struct<kind, start, end, base>>`` in code points, end exclusive, by start, then kind.

    ``base`` tells spans of the fixed patterns. A missing or empty text has no spans. Repeated ids each keep a row, a missing id stays.
    Without ``weights`` the field is trained on a sample of the same table; an empty table trains on made-up text and gives no rows.
    Texts are scanned whole, without a shuffle; other columns are not read.
    """
    on_workers(docs.sparkSession)
    weights = fitted(docs, id_column=id_column, text=text) if weights is None else weights
    kind = docs.schema[id_column].dataType.simpleString()
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(weights)
        for batch in pieces_of(batches, "text"):
            rows = []
            for t in batch.column(1).to_pylist():
                base, added = spans_of(t or "", field)
                spans = [(a, b, k, True) for a, b, k in base] + [(a, b, k, False) for a, b, k in added]
                spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
                rows.append([{"kind": k, "start": a, "end": b, "base": own} for a, b, k, own in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, shape)], [id_column, "spans"])

    given = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text}`").alias("text"))
    return given.mapInArrow(run, f"`{id_column}` {kind}, spans array<struct<kind: string, start: int, end: int, base: boolean>>")
