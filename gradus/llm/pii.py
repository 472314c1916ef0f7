"""Personal data by fixed patterns and a semi-Markov conditional random field.

Base spans come of four patterns with their checks (email, ip, card, phone); they always
stay. The field adds what the patterns miss, such as national phone numbers, masked e-mail
addresses, social security numbers and account numbers. It segments the tokens around
digits and at-signs: a segment is one token outside any entity or an entity of at most
MAX_TOKENS tokens, MAX_CHARS characters and MAX_DIGITS digits, and whole-span features (shape, lengths of digit runs, checksums, edges,
the word before) score each candidate with each type. A dynamic programme over segments
jointly chooses boundaries and types, as candidates stream by. A span counts if it scores
MARGIN over leaving it out.

Weights are learnt by stochastic gradient on the exact conditional likelihood (forward and
backward sums over all segmentations) from sentences that a seeded generator makes, with
dates, prices, versions and other numbers as counterexamples. No document is learnt from.

Defined cases: null text is empty and has no spans; spans of the field that overlap a base
span are left out; repeated rows repeat; an empty table gives an empty result; further
columns are ignored. Texts are read whole; patterns are anchored so that long runs take
linear time, and the field's work is linear in the tokens near digits.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import clear_of, exact
from .secrets import digest

KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
MAX_TOKENS, MARGIN = 14, 2.0
#: Characters to either side of a trigger that the field reads, and up to MAX_CHARS more of an unfinished word.
AROUND = 60
#: The longest legal e-mail address, and the most digits an account number can have.
MAX_CHARS, MAX_DIGITS = 320, 34
SENTENCES, EPOCHS, SEED = 360, 5, 11

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def octets(parts: list[str]) -> bool:
    """Whether each number is at most 255, however many zeros it begins with."""
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48 << i % 2
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    """Matches of the pattern [local]+@[label]+(.[label]+)+, found from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        # What lies before this @ can be part of no later match.
        done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if octets(m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# The field.

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_TRIGGER = re.compile(r"[0-9]{2,}|@|[\[(]\s?at\s?[\])]|\bat\b.{1,40}?\bdot\b", re.IGNORECASE)
_MASKED = re.compile(r"^[\w.+-]+\s?[\[(]?\s?(?:at|@)\s?[\])]?\s?[\w-]+(?:\s?(?:[\[(]\s?dot\s?[\])]|\bdot\b|\.)\s?[\w-]+)+$", re.IGNORECASE)
_SHAPES = ((re.compile(r"[0-9]+"), "9"), (re.compile(r"[A-Za-z]+"), "a"))
_HINTS = {
    "phone": "phone", "tel": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "telefon": "phone",
    "ssn": "ssn", "security": "ssn", "iban": "iban", "account": "iban", "konto": "iban", "email": "email",
    "mail": "email", "contact": "email", "card": "card", "visa": "card", "ip": "ip", "host": "ip",
    "version": "other", "order": "other", "page": "other", "date": "other", "total": "other", "price": "other",
}


def _iban(s: str) -> bool:
    s = s.replace(" ", "").upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def span_features(text: str, start: int, end: int, n_tokens: int, before: str) -> list[str]:
    s = text[start:end]
    runs = [len(x) for x in re.findall(r"[0-9]+", s)]
    digits = sum(runs)
    shape = s
    for pattern, mark in _SHAPES:
        shape = pattern.sub(mark, shape)
    left, right = text[start - 1 : start], text[end : end + 1]
    out = ["bias", f"digits={min(digits, 20)}", f"tokens={n_tokens}", f"hint={_HINTS.get(before, '')}"]
    out.append("shape=" + (shape if len(shape) <= 16 else "long"))
    out.append("runs=" + ("-".join(map(str, runs)) if len(runs) <= 6 else "many"))
    out.append("left=" + ("" if not left or left.isspace() else "x" if left.isalnum() else left))
    out.append("right=" + ("" if not right or right.isspace() else "x" if right.isalnum() else right))
    if 12 <= digits <= 19 and shape.strip("9 -") == "":
        out.append(f"luhn={luhn(re.sub('[^0-9]', '', s))}")
    if len(runs) == 4 and shape == "9.9.9.9":
        out.append(f"octets={octets(s.split('.'))}")
    if s[:2].isalpha() and s[:2].isupper() and s[2:4].isdigit() and len(s) >= 15:
        out.append(f"iban={_iban(s)}")
    if _MASKED.match(s):
        out.append("masked")
    if "@" in s:
        out.append("at")
    if s[0] == "+":
        out.append("plus")
    if s.count("(") != s.count(")") or s.count("[") != s.count("]"):
        out.append("open")
    return out


def candidates(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[str]]]:
    """(first token, token after the last, features) of spans that may be entities, by first token."""
    words = [text[a:b] for a, b in tokens]
    for i, (start, _) in enumerate(tokens):
        if not (words[i].isalnum() or words[i] in "+("):
            continue
        before = next((w.lower() for w in reversed(words[max(0, i - 3) : i]) if w.isalpha()), "")
        digits = ats = 0
        masked = False
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            if j > i and tokens[j][0] - tokens[j - 1][1] > 1:
                break
            if "\n" in text[tokens[j - 1][1] if j > i else start : tokens[j][0]]:
                break
            word = words[j]
            digits += len(word) if word.isdigit() else 0
            ats += word == "@"
            if digits > MAX_DIGITS or ats > 1 or tokens[j][1] - start > MAX_CHARS:
                break
            masked |= word == "@" or word.lower() == "at"
            if word.isalnum() and (digits >= 7 or masked and j - i >= 2):
                yield i, j + 1, span_features(text, start, tokens[j][1], j + 1 - i, before)


def _score(weights: dict, y: int, features: list[str]) -> float:
    own = weights[y]
    return sum(own.get(f, 0.0) for f in features)


def best_segments(n: int, found: Iterable, weights: dict) -> list[tuple[int, int, int]]:
    """(first, after last, kind) of the best segmentation's entities that score MARGIN.

    found: candidates by first token; of equally good segmentations, the one with fewer entities.
    """
    best, back, at = [0.0] * (n + 1), [None] * (n + 1), 0

    def advance(to):
        for k in range(at + 1, to + 1):
            if best[k - 1] >= best[k]:
                best[k], back[k] = best[k - 1], None
        return to

    for i, j, features in found:
        at = advance(i)
        for y in range(len(KINDS)):
            s = _score(weights, y, features)
            if s >= MARGIN and best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, j, y)
    advance(n)
    out, j = [], n
    while j > 0:
        if back[j]:
            out.append(back[j])
            j = back[j][0]
        else:
            j -= 1
    return out[::-1]


def _log_add(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def gradient(n: int, found: list, truth: set, weights: dict) -> list[tuple[int, list[str], float]]:
    """(kind, features, expected less observed) of each candidate, by forward and backward sums."""
    edges = [(i, j, y, f, _score(weights, y, f)) for i, j, f in found for y in range(len(KINDS))]
    by_end, by_start = defaultdict(list), defaultdict(list)
    for e in edges:
        by_end[e[1]].append(e)
        by_start[e[0]].append(e)
    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        alpha[j] = _log_add([alpha[j - 1], *(alpha[e[0]] + e[4] for e in by_end[j])])
    for i in range(n - 1, -1, -1):
        beta[i] = _log_add([beta[i + 1], *(beta[e[1]] + e[4] for e in by_start[i])])
    out = []
    for i, j, y, f, s in edges:
        g = math.exp(alpha[i] + s + beta[j] - alpha[n]) - ((i, j, y) in truth)
        if abs(g) > 1e-4:
            out.append((y, f, g))
    return out


def sentences(seed: int = SEED, count: int = SENTENCES):
    """Made-up text and its entities (start, kind, end)."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("ba", "ten", "lor", "mi", "ques", "an", "der", "ou", "st", "ka")) for _ in range(rng.randint(1, 3)))

    def card():
        body = rng.choice("456") + digits(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        return rng.choice((body, " ".join(body[i : i + 4] for i in range(0, 16, 4)), "-".join(body[i : i + 4] for i in range(0, 16, 4))))

    def iban():
        country, body = rng.choice(("DE", "FR", "ES", "NL")), digits(rng.choice((14, 18, 20)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        s = f"{country}{check:02d}{body}"
        return s if rng.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    def email():
        name, host, end = rng.choice((word(), f"{word()}.{word()}")), word(), rng.choice(("com", "org", "net", "de"))
        return rng.choice((f"{name}@{host}.{end}", f"{name} [at] {host} [dot] {end}", f"{name} (at) {host}.{end}", f"{name} at {host} dot {end}"))

    def phone():
        a, b, c = rng.choice("23456789") + digits(2), rng.choice("23456789") + digits(2), digits(4)
        return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}"))

    ip = lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4))
    ssn = lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"
    made = (email, ip, card, phone, ssn, iban)

    def other():
        y, m, d = rng.randint(1900, 2030), rng.randint(1, 12), rng.randint(1, 28)
        return rng.choice((
            f"{y}-{m:02d}-{d:02d}", f"{d}/{m}/{y}", f"{d}.{m}.{y}", f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}",
            f"{digits(3)},{digits(3)}.{digits(2)}", f"{y}-{y + 4}", f"{digits(2)}:{digits(2)}:{digits(2)}", digits(rng.randint(7, 20)),
            f"pp. {digits(3)}-{digits(3)}", f"{digits(3)} {digits(3)} {digits(3)}", f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
            f"${digits(4)}.{digits(2)}", " ".join(digits(1) for _ in range(9)), f"{word()} at {word()} {word()}", f"{digits(4)}-{digits(4)}",
            f"{digits(5)}-{digits(5)}", f"{y} {y + 1} {y + 2}", f"{word()}{digits(9)}", f"300.{digits(3)}.{digits(3)}.{digits(3)}",
        ))

    hints = [k for k in _HINTS]
    for _ in range(count):
        text, entities = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(1, 4))) + " "
            kind = rng.randrange(len(made)) if rng.random() < 0.5 else None
            if rng.random() < 0.25:
                text += (rng.choice([h for h in hints if kind is None or _HINTS[h] == KINDS[kind]])) + rng.choice((" ", ": "))
            s = other() if kind is None else made[kind]()
            if kind is not None:
                entities.append((len(text), kind, len(text) + len(s)))
            text += s + rng.choice((" ", ". ", ", "))
        yield text + word(), entities


@lru_cache(1)
def train() -> dict[int, dict[str, float]]:
    """Weights by kind and feature."""
    data = []
    for text, entities in sentences():
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        first, after = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
        truth = {(first[s], after[e], k) for s, k, e in entities if s in first and e in after}
        data.append((len(tokens), list(candidates(text, tokens)), truth))
    weights = {y: defaultdict(float, {"bias": -2.0}) for y in range(len(KINDS))}
    squares = {y: defaultdict(float) for y in range(len(KINDS))}
    rng = random.Random(SEED)
    for _ in range(EPOCHS):
        rng.shuffle(data)
        for n, found, truth in data:
            for y, features, g in gradient(n, found, truth, weights):
                for f in features:
                    squares[y][f] += g * g
                    weights[y][f] -= 0.5 * g / math.sqrt(1e-2 + squares[y][f])
    return {y: dict(w) for y, w in weights.items()}


def field_spans(text: str, weights: dict) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the field's entities, from the tokens around triggers."""
    areas: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        least, most = max(0, a - MAX_CHARS), min(len(text), b + MAX_CHARS)
        while least < a and text[a].isalnum() and text[a - 1].isalnum():
            a -= 1
        while b < most and text[b - 1].isalnum() and text[b].isalnum():
            b += 1
        if areas and a <= areas[-1][1]:
            areas[-1][1] = max(b, areas[-1][1])
        else:
            areas.append([a, b])
    out = []
    for a, b in areas:
        tokens = [m.span() for m in _TOKEN.finditer(text, a, b)]
        out += [(tokens[i][0], y, tokens[j - 1][1]) for i, j, y in best_segments(len(tokens), candidates(text, tokens), weights)]
    return out


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (all): arrays of (start, kind, end), kind as its place in KINDS."""
    from pyspark.sql.pandas.types import to_arrow_type

    source = docs.select(exact(docs, "doc_id").alias("doc_id"), exact(docs, "text").cast("string").alias("text"))
    kind, weights = source.schema["doc_id"].dataType, train()
    id_type = to_arrow_type(kind)

    def run(batches):
        of = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
        for batch in batches:
            base, every = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                known = base_spans(text)
                clear = clear_of([(s, e) for s, _, e in known])
                more = [x for x in field_spans(text, weights) if clear(x[0], x[2])]
                base.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in known])
                every.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in sorted(known + more)])
            yield pa.record_batch([batch.column("doc_id").cast(id_type), pa.array(base, of), pa.array(every, of)], ["doc_id", "base", "spans"])

    span = "array<struct<start:bigint,kind:int,end:bigint>>"
    return source.mapInArrow(run, f"doc_id {kind.simpleString()}, base {span}, spans {span}")


def op4_pii(spark, sf_dir: str) -> DataFrame:
    return digest(find(spark.read.parquet(f"{sf_dir}/documents.parquet")), KINDS, 4)
