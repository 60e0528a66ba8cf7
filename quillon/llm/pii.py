"""Personal data: exact base patterns plus a semi-Markov conditional random field over candidate segments.

Base spans (email, ip, card, phone) follow fixed patterns, found in linear time. The field then reads windows of tokens around
digits, at-signs and spelled-out addresses. Whole-segment features (shape, digit count, checksum, range, context words, borders)
score every candidate segment of at most MAX_TOKENS tokens, and Viterbi search over segmentations chooses borders and kinds
jointly. Base spans stay; segments that overlap none of them are added (national phone numbers, addresses written out, spaced cards).

The field is trained on the driver by conditional likelihood on seeded, generated sentences (no labelled corpus is needed), once
for each process; its weights are a few dozen numbers.

Defined results: a null text is empty and has no spans; repeated rows give equal rows; an empty table gives no rows; other columns
are ignored. Windows are merged without a cap on their number, and the whole text is read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Fixed order of kinds.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
MAX_TOKENS = 24
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str) -> Iterator[Span]:
    """Each at-sign with a domain behind it takes the whole run of local characters before it, down to the last match."""
    floor, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        start = at
        if m:
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
        if m and start < at:
            yield "email", start, m.end()
            floor = m.end()
            at = text.find("@", floor)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    out = list(emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# --- the field -------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_|\w")
_SEED = re.compile(r"[0-9@]+")
_SPELLED = re.compile(r"[(\[]at[)\]]", re.IGNORECASE)
_SHAPES = {
    "email": re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+"),
    "spelled": re.compile(r"[\w.%+-]+ ?[(\[]at[)\]] ?[\w-]+(?:(?:\.| ?[(\[]dot[)\]] ?)[\w-]+)+", re.IGNORECASE),
    "quad": re.compile(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"),
    "fours": re.compile(r"\d{4}([ .-]?)\d{4}\1\d{4}\1\d{4}"),
    "amex": re.compile(r"\d{4}([ .-]?)\d{6}\1\d{5}"),
    "national": re.compile(r"\(\d{2,4}\) ?\d{3,4}[ .-]\d{3,4}"),
    "dashed": re.compile(r"\d{3}[.-]\d{3}[.-]\d{4}"),
    "plus": re.compile(r"\+\d[\d ().-]+\d"),
    "date": re.compile(r"\d{1,4}[-./]\d{1,2}[-./]\d{1,4}"),
}
#: Fixed context words by what they announce.
_CUES = {
    "phone": frozenset("call phone tel telephone fax mobile cell whatsapp dial".split()),
    "email": frozenset("mail email contact write reach".split()),
    "ip": frozenset("ip server host from address login".split()),
    "card": frozenset("card visa mastercard amex credit debit payment".split()),
    "other": frozenset("version order isbn id serial invoice build release v no number item".split()),
}


def tokens_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def segment_features(text: str, start: int, end: int) -> list[str] | None:
    """Features of a whole segment; None if it can't be an entity (no digit or at-sign, a line break, ragged ends)."""
    seg = text[start:end]
    if "\n" in seg or not (seg[0].isalnum() or seg[0] in "+(") or not seg[-1].isalnum():
        return None
    digits = _NOT_DIGIT.sub("", seg)
    out = [f"is:{name}" for name, shape in _SHAPES.items() if shape.fullmatch(seg)]
    if not out:
        return None
    n = len(digits)
    out.append("digits:" + ("0" if n == 0 else "1-6" if n < 7 else "7-9" if n < 10 else "10-12" if n < 13 else "13-15" if n < 16 else "16-19" if n < 20 else "20+"))
    if n >= 13:
        out.append("luhn" if luhn(digits) else "no-luhn")
    if "is:quad" in out:
        out.append("octets" if all(map(_octet, seg.split("."))) else "no-octets")
    before = text[start - 1] if start else " "
    after = text[end] if end < len(text) else " "
    if before.isalnum() or before in "._@-+/=#$":
        out.append("glued-before")
    if after.isalnum() or after in "_@%/" or (after in "-." and end + 1 < len(text) and text[end + 1].isalnum()):
        out.append("glued-after")
    words = re.findall(r"[^\W\d_]+", text[max(0, start - 40) : start].lower())[-2:]
    out += [f"cue:{k}" for k, cues in _CUES.items() if cues & set(words)]
    return out


def candidates(text: str, toks: list[tuple[int, int]]) -> dict[tuple[int, int], list[str]]:
    """Features of each segment of tokens that may be an entity, by (first, last + 1)."""
    out = {}
    for i, (start, _) in enumerate(toks):
        if not (text[start].isalnum() or text[start] in "+("):
            continue
        for j in range(i + 1, min(len(toks), i + MAX_TOKENS) + 1):
            if j - i >= 2 and text[toks[j - 2][1] : toks[j - 1][0]] not in ("", " "):
                break
            if f := segment_features(text, start, toks[j - 1][1]):
                out[i, j] = f
    return out


Weights = dict[tuple[str, str], float]


def _score(w: Weights, label: str, features: list[str]) -> float:
    return w.get((label, "bias"), 0.0) + sum(w.get((label, f), 0.0) for f in features)


def decode(text: str, toks: list[tuple[int, int]], w: Weights) -> list[Span]:
    """The best segmentation: best[j] is the score of the best one of the first j tokens; outside tokens score 0."""
    segs: dict[int, list[tuple[int, str, float]]] = {}
    for (i, j), features in candidates(text, toks).items():
        for label in KINDS:
            s = _score(w, label, features)
            if s > 0:
                segs.setdefault(j, []).append((i, label, s))
    best, back = [0.0], [None]
    for j in range(1, len(toks) + 1):
        score, step = best[j - 1], None
        for i, label, s in segs.get(j, ()):
            if best[i] + s > score:
                score, step = best[i] + s, (i, label)
        best.append(score)
        back.append(step)
    out, j = [], len(toks)
    while j:
        step = back[j]
        if step:
            out.append((step[1], toks[step[0]][0], toks[j - 1][1]))
            j = step[0]
        else:
            j -= 1
    return out[::-1]


def _sentence(rng: random.Random) -> tuple[str, set[Span]]:
    """A generated sentence and its entities, with numbers that are none."""
    word = lambda: "".join(rng.choice("abdeghilmnorstu") for _ in range(rng.randint(2, 8)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        head = rng.choice("3456") + num(14)
        return next(head + d for d in "0123456789" if luhn(head + d))

    def grouped(d: str) -> str:
        sep = rng.choice(["", " ", "-", "."])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def bad_card() -> str:
        d = card()
        return grouped(d[:-1] + str((int(d[-1]) + rng.randint(1, 9)) % 10))

    octet = lambda: str(rng.randint(0, 255))
    makers = {
        "email": lambda: rng.choice([f"{word()}.{word()}@{word()}.com", f"{word()}{num(2)}@{word()}.example.org", f"{word()} (at) {word()} (dot) com", f"{word()}[at]{word()}.net"]),
        "ip": lambda: ".".join(octet() for _ in range(4)),
        "card": lambda: grouped(card()),
        "phone": lambda: rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"+{rng.randint(1, 9)}{num(1)} {num(3)} {num(7)}", f"{num(3)}-{num(3)}-{num(4)}", f"+1 ({num(3)}) {num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}"]),
        "": lambda: rng.choice([f"{rng.randint(1, 9)}.{rng.randint(0, 9)}", f"20{num(2)}-0{rng.randint(1, 9)}-{num(2)}", num(rng.randint(1, 12)), num(20), bad_card(), f"{rng.randint(256, 999)}.{octet()}.{octet()}.{octet()}", f'key = "{num(9)}ab{num(9)}"', f"{octet()}.{octet()}.{octet()}.{octet()}.{octet()}", f"x{num(3)}-{num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}-{num(3)}", f"${num(3)}.{num(3)}.{num(4)}"]),
    }
    cues = {"email": "email", "ip": "server", "card": "card", "phone": "call", "": "version"}
    text, spans = word(), set()
    for _ in range(rng.randint(1, 3)):
        kind = rng.choice([*KINDS, "", ""])
        text += " " + " ".join(word() for _ in range(rng.randint(1, 4)))
        if rng.random() < 0.3:
            text += " " + cues[kind]
        text += " "
        value = makers[kind]()
        if kind:
            spans.add((kind, len(text), len(text) + len(value)))
        text += value
    return text + rng.choice(["", ".", " " + word() + "."]), spans


Scored = tuple[int, int, str, list[str], float]


def scored(cands: dict[tuple[int, int], list[str]], w: Weights) -> list[Scored]:
    """Every candidate segment with every kind: first, last + 1, kind, features, score."""
    return [(i, j, k, f, _score(w, k, f)) for (i, j), f in cands.items() for k in KINDS]


def marginals(n: int, segments: list[Scored]) -> tuple[list[float], float]:
    """The probability of each segment over all segmentations of n tokens, and the log of the sum of their weights (forward-backward)."""
    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    ending: dict[int, list[Scored]] = {}
    starting: dict[int, list[Scored]] = {}
    for x in segments:
        ending.setdefault(x[1], []).append(x)
        starting.setdefault(x[0], []).append(x)
    add = lambda terms: (m := max(terms)) + math.log(sum(math.exp(t - m) for t in terms))
    for j in range(1, n + 1):
        ahead[j] = add([ahead[j - 1], *(ahead[x[0]] + x[4] for x in ending.get(j, ()))])
    for i in range(n - 1, -1, -1):
        behind[i] = add([behind[i + 1], *(x[4] + behind[x[1]] for x in starting.get(i, ()))])
    return [math.exp(ahead[i] + s + behind[j] - ahead[n]) for i, j, _, _, s in segments], ahead[n]


@lru_cache(maxsize=1)
def trained(sentences: int = 500, epochs: int = 8, seed: int = 11) -> tuple[tuple[tuple[str, str], float], ...]:
    """Weights that maximise the conditional likelihood of the generated segmentations (stochastic gradient steps)."""
    rng = random.Random(seed)
    data = []
    for _ in range(sentences):
        text, spans = _sentence(rng)
        toks = tokens_of(text)
        cands = candidates(text, toks)
        gold = {(i, j): kind for (i, j) in cands for kind, a, b in spans if (toks[i][0], toks[j - 1][1]) == (a, b)}
        data.append((len(toks), cands, gold))
    w: Weights = {}
    for epoch in range(epochs):
        rate = 0.5 / (1 + epoch)
        for n, cands, gold in data:
            segments = scored(cands, w)
            for (i, j, k, f, _), p in zip(segments, marginals(n, segments)[0], strict=True):
                gradient = (gold.get((i, j)) == k) - p
                if abs(gradient) > 1e-6:
                    for name in ("bias", *f):
                        w[k, name] = w.get((k, name), 0.0) * (1 - 1e-4 * rate) + rate * gradient
    return tuple(sorted(w.items()))


def windows(text: str, before: int = 48, after: int = 64) -> Iterator[tuple[int, int]]:
    """Stretches of text around digits, at-signs and spelled-out ones, merged where they meet, ending at blanks."""
    seeds = [m.span() for m in _SEED.finditer(text)]
    if _SPELLED.search(text):
        seeds = sorted(seeds + [m.span() for m in _SPELLED.finditer(text)])
    start = end = -1
    for a, b in seeds:
        a, b = max(0, a - before), min(len(text), b + after)
        if a <= end:
            end = max(end, b)
            continue
        if end > 0:
            yield start, end
        start, end = a, b
    if end > 0:
        yield start, end


def field_spans(text: str, w: Weights) -> Iterator[Span]:
    for a, b in windows(text):
        while a and not text[a - 1].isspace() and text[a - 1] not in "\"'":
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        toks = [(x + a, y + a) for x, y in tokens_of(text[a:b])]
        yield from decode(text, toks, w)


def find(text: str, w: Weights) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by kind as listed, then start."""
    base = base_spans(text)
    order = lambda s: (KINDS.index(s[0]), s[1], s[2])
    extra = []
    if _DIGIT.search(text) or "@" in text or _SPELLED.search(text):
        taken = sorted((a, b) for _, a, b in base)
        for kind, a, b in field_spans(text, w):
            if not any(x < b and a < y for x, y in taken):
                extra.append((kind, a, b))
    return base, sorted(base + extra, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _finder(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                base, spans = find(text, weights)
                kinds = [s[0] for s in base]
                for o, v in zip(out, [*map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)], strict=True):
                    o.append(v)
            kinds_ = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, k) for o, k in zip(out, kinds_, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans (base and field) as kind:start:end."""
    weights = dict(trained())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_finder(weights), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
