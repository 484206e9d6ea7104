"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The field scores whole candidate segments (their digits, separators, checksums and borders) and a
dynamic program over segments of bounded length chooses boundaries and types together.  It is
trained on windows around pattern matches of a bounded sample, some of them rewritten the way
people hide addresses and numbers.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lendlane.llm.shared import slices, texts

# The kinds in order and their patterns.  The forms below match what the plain
# patterns match; possessive repeats and the skipping of digit runs keep them linear.
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+
#   phone \+[0-9][\x20().0-9-]+[0-9]
KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)|[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# all that can stand for the "@" of a hidden address; a plain "at" only where a host with a dot of any form follows
_TRIGGER = re.compile(
    r"[0-9@]|[(\[]\s*+at\s*+[)\]]|\sat\s++(?=[a-z0-9-]++(?:\.|\s*+[(\[]\s*+(?:dot|\.)\s*+[)\]]\s*+|\s++dot\s++)[a-z0-9-])", re.I)

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    """Whether the checksum digit is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        done = found.end() if found else at
        if found:
            yield start, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """What the patterns find: per kind leftmost and without overlap, failing matches dropped."""
    spans = [(a, b, "email") for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if m[1] and all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            spans.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        number = _digits(m[0]) if m.end() - m.start() < 40 else ""
        if 14 <= len(number) <= 19 and luhn(number):
            spans.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            spans.append((*m.span(), "phone"))
    return sorted(spans, key=_order)


def _order(span: Span):
    return span[0], KINDS.index(span[2])


# ---------------------------------------------------------------- the field

@dataclass(frozen=True)
class Settings:
    """``windows`` bounds the training windows; ``longest`` the tokens of an entity."""

    windows: int = 600
    longest: int = 16
    around: int = 6
    rounds: int = 6
    margin: float = 1.0


_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
_AT = re.compile(r"\s*[(\[]\s*at\s*[)\]]\s*|\s+at\s+", re.I)
_PROSE = re.compile(r"\s+at\s+[a-z0-9-]+\.[a-z0-9-]", re.I)
_DOT = re.compile(r"\s*[(\[]\s*(?:dot|\.)\s*[)\]]\s*|\s+dot\s+", re.I)
_OPEN, _SHUT = set("+([") , set(")]")


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


def segment_features(text: str, start: int, end: int, tokens: int) -> list[str]:
    """What a whole candidate segment looks like."""
    s = text[start:end]
    ats, dots = len(_AT.findall(s)), len(_DOT.findall(s))
    plain = _DOT.sub(".", _AT.sub("@", s))
    number = _digits(s)
    letters = any(c.isalpha() for c in plain)
    bare = "@" not in s and not re.search(r"[(\[]\s*at\s*[)\]]", s, re.I)
    parts = plain.split(".")
    before, after = text[start - 1:start], text[end:end + 1]
    out = [
        "bias", f"digits {_bucket(len(number), (1, 4, 7, 10, 12, 14, 17, 20))}", f"letters {letters}",
        f"at {plain.count('@')}", f"dots {min(plain.count('.'), 4)}", f"spaces {min(plain.count(' '), 5)}",
        f"tokens {_bucket(tokens, (2, 4, 7, 10, 13))}", f"odd {bool(re.search(r'[^A-Za-z0-9._%+@ ()/-]', plain))}",
        f"hidden {min(ats + dots, 2)}", f"plain at {min(ats, 1) * bare} {min(dots, 1)}", f"glued left {before.isalnum() or before in ('@', '_', '-', '+', '.')}",
        f"glued right {after.isalnum() or after in ('@', '_', '-')}", f"cut right {after == '.' and text[end + 1:end + 2].isalnum()}",
    ]
    if re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", plain):
        out.append("address")
    if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts):
        out.append("octets")
    if not letters and 14 <= len(number) <= 19 and luhn(number):
        out.append("luhn")
    if not letters and re.fullmatch(r"\+?\(?[0-9][0-9 ().-]*[0-9]", plain) and 10 <= len(number) <= 15:
        out.append(f"dialled {'+' in plain} {len(re.findall('[0-9]+', plain)) in (3, 4, 5)}")
    return out


def _possible(features: list[str]) -> list[str]:
    """The kinds a segment can be at all."""
    shape = {f.split(" ")[0] for f in features}
    return [k for k, needs in zip(KINDS, ("address", "octets", "luhn", "dialled")) if needs in shape]


class Field:
    """Weights per kind and feature, and the best segmentation under them."""

    def __init__(self, weights: dict[tuple[str, str], float], settings: Settings = Settings()):
        self.weights, self.settings = weights, settings

    def score(self, kind: str, features: list[str]) -> float:
        return sum(self.weights.get((kind, f), 0.0) for f in features)

    def candidates(self, text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[str]]]:
        """Segments of at most ``longest`` tokens that begin and end like an entity and hold a trigger."""
        for i, (start, _) in enumerate(tokens):
            if not (text[start].isalnum() or text[start] in _OPEN):
                continue
            for j in range(i + 1, min(len(tokens), i + self.settings.longest) + 1):
                end = tokens[j - 1][1]
                if "\n" in text[start:end]:
                    break
                if (text[end - 1].isalnum() or text[end - 1] in _SHUT) and _TRIGGER.search(text, start, end) and j - i > 1 or (
                        j - i == 1 and end - start >= 7 and text[start].isdigit()):
                    yield i, j, segment_features(text, start, end, j - i)

    def best(self, text: str, tokens: list[tuple[int, int]], margin: float) -> list[tuple[int, int, str, list[str]]]:
        """The highest-scoring segmentation; tokens outside entities score 0, entities less a margin."""
        out, open_, reach = [], [], 0
        for i, j, features in self.candidates(text, tokens):
            if i >= reach:  # nothing crosses this place, so what is before it is settled
                out += _chosen(open_)
                open_ = []
            score, kind = max(((self.score(k, features), k) for k in _possible(features)), default=(margin, ""))
            if score > margin:
                open_.append((score - margin, i, j, kind, features))
                reach = max(reach, j)
        return out + _chosen(open_)

    def spans(self, text: str, free_of: list[Span]) -> list[Span]:
        """Entities in the windows around triggers that do not touch the given spans."""
        taken, out = sorted((a, b) for a, b, _ in free_of), []
        for lo, hi in _windows(text, taken):
            tokens = [(lo + m.start(), lo + m.end()) for m in _TOKEN.finditer(text[lo:hi])]
            for piece in _parts(tokens, taken):
                out += [(piece[i][0], piece[j - 1][1], kind) for i, j, kind, _ in self.best(text, piece, self.settings.margin)]
        return out


def _chosen(segments: list[tuple[float, int, int, str, list[str]]]) -> list[tuple[int, int, str, list[str]]]:
    """Of scored segments those without overlap that score most together."""
    if not segments:
        return []
    ending, low = defaultdict(list), segments[0][1]
    for score, i, j, kind, features in segments:
        ending[j - low].append((score, i - low, kind, features))
    n = max(ending)
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for score, i, kind, features in ending[j]:
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, kind, features)
    out, j = [], n
    while j:
        if back[j]:
            i, kind, features = back[j]
            out.append((i + low, j + low, kind, features))
            j = i
        else:
            j -= 1
    return out[::-1]


def _parts(tokens, taken) -> Iterator[list[tuple[int, int]]]:
    """Runs of tokens between the taken spans, however long."""
    run, at = [], 0
    for a, b in tokens:
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at < len(taken) and taken[at][0] < b:
            if run:
                yield run
            run = []
            continue
        run.append((a, b))
    if run:
        yield run


def _windows(text: str, taken=(), around: int = 48) -> list[tuple[int, int]]:
    """Ranges around the triggers outside ``taken``, widened to white space and merged."""
    out, at = [], 0
    for m in _TRIGGER.finditer(text):
        p = m.start()
        while at < len(taken) and taken[at][1] <= p:
            at += 1
        if at < len(taken) and taken[at][0] <= p:
            continue
        if out and p < out[-1][1] - around // 2 and m.end() == p + 1:
            continue
        # a spelled address has no further trigger, so it is all within reach
        lo, hi = max(0, p - around), min(len(text), m.end() + around * (1 if m.end() == p + 1 else 4))
        while lo > 0 and not text[lo - 1].isspace() and p - lo < 4 * around:
            lo -= 1
        while hi < len(text) and not text[hi].isspace() and hi - p < 4 * around:
            hi += 1
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


# ---------------------------------------------------------------- training

def _rewritten(kind: str, s: str, dice: random.Random) -> str:
    """An entity as it is, or in a form the patterns do not know."""
    form = dice.randrange(4)
    if kind == "email" and form:
        name, _, host = s.partition("@")
        at, dot = ((" (at) ", "."), (" [at] ", " [dot] "), (" at ", " dot "))[form - 1]
        return name + at + host.replace(".", dot)
    if kind == "ip" and form == 1:
        return s.replace(".", "[.]")
    number = _digits(s)
    if kind == "card" and form:
        return "./ "[form - 1].join(number[i:i + 4] for i in range(0, len(number), 4))
    if kind == "phone" and form:
        n = number[-10:]
        return (f"({n[:3]}) {n[3:6]}-{n[6:]}", f"{n[:3]}-{n[3:6]}-{n[6:]}", f"{n[:3]}.{n[3:6]}.{n[6:]}")[form - 1]
    return s


def examples(text: str, most: int = 4, seed: int = 0) -> Iterator[tuple[str, list[Span]]]:
    """Training windows of a text: with one entity each, and windows with a trigger but none."""
    dice, spans = random.Random(f"{seed}/{len(text)}"), base_spans(text)
    for start, end, kind in spans[:most]:
        lo, hi = max(0, start - 40), min(len(text), end + 40)
        if any(a < hi and b > lo and (a, b) != (start, end) for a, b, _ in spans):
            continue
        entity = _rewritten(kind, text[start:end], dice)
        yield text[lo:start] + entity + text[end:hi], [(start - lo, start - lo + len(entity), kind)]
    for lo, hi in _windows(text, [(a, b) for a, b, _ in spans])[:most]:
        if not any(a < hi and b > lo for a, b, _ in spans):
            yield text[lo:hi], []


def train(windows: list[tuple[str, list[Span]]], settings: Settings = Settings()) -> Field:
    """Averaged structured perceptron: the best segmentation is moved towards the given one."""
    weights, total, steps = defaultdict(float), defaultdict(float), 0
    field = Field(weights, settings)
    prepared = []
    for text, gold in windows:
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        prepared.append((text, tokens, [
            (kind, segment_features(text, a, b, sum(a <= s and e <= b for s, e in tokens)), (a, b)) for a, b, kind in gold]))
    dice = random.Random(11)
    for _ in range(settings.rounds):
        dice.shuffle(prepared)
        for text, tokens, gold in prepared:
            steps += 1
            guess = {(tokens[i][0], tokens[j - 1][1], k): f for i, j, k, f in field.best(text, tokens, 0.0)}
            right = {(a, b, k): f for k, f, (a, b) in gold}
            for spans, sign in ((right, 1.0), (guess, -1.0)):
                for (a, b, kind), features in spans.items():
                    if (a, b, kind) not in (guess if sign > 0 else right):
                        for f in features:
                            weights[kind, f] += sign
                            total[kind, f] += sign * steps
    return Field({k: w - total[k] / max(steps, 1) for k, w in weights.items() if w or total[k]}, settings)


def fit(docs: DataFrame, settings: Settings = Settings()) -> Field:
    """Train on a bounded sample: per kind of window the first ``windows`` by a hash of id and place.

    The windows are short, so the sample is small whatever the texts are.  No match, no field.
    Windows without an entity but with a host after a plain "at" are a kind of their own, as they are
    few and look like hidden addresses.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(w, s) for t in texts(batch) if _TRIGGER.search(t) for w, s in examples(t)]
            yield pa.RecordBatch.from_pydict({
                "window": [w for w, _ in rows], "start": [s[0][0] if s else -1 for _, s in rows],
                "end": [s[0][1] if s else -1 for _, s in rows], "kind": [s[0][2] if s else "at" if _PROSE.search(w) else "" for w, s in rows],
            }, schema=pa.schema([("window", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    found = docs.select("text").mapInArrow(run, "window string, start int, end int, kind string").where(F.length("window") <= 400)
    each = settings.windows // (len(KINDS) + 2)
    rows = []
    for kind, own in _sample(found, each).items():
        rows += [(w, [(a, b, kind)] if kind in KINDS else []) for w, a, b in own]
    return train(rows, settings) if any(s for _, s in rows) else Field({}, settings)


def _sample(found: DataFrame, each: int) -> dict[str, list[tuple[str, int, int]]]:
    """Per kind the ``each`` windows with the smallest hash: one pass, bounded state per task."""
    key = F.struct(F.xxhash64("window").alias("k"), "window", "start", "end")
    # windows fall into slots by their hash; each slot keeps its smallest, so state is bounded
    slots = found.groupBy("kind", F.pmod(F.xxhash64("window", F.lit(5)), F.lit(each)).alias("slot")).agg(F.min(key).alias("w"))
    out = defaultdict(list)
    for r in slots.orderBy("kind", "slot").collect():
        out[r.kind].append((r.w.window, r.w.start, r.w.end))
    return dict(sorted(out.items()))


# ---------------------------------------------------------------- the operator

def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """Per document the counts of the patterns, the digest of their spans, and all spans.

    ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added``.  NULL texts are empty
    and have no spans.  Offsets are code points; ends are exclusive.  Rows are independent.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    types = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()),
                       ("spans", pa.string()), ("n_added", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = {name: [] for name in types.names}
            for text in texts(batch):
                base, added = all_spans(text, field)
                for k in KINDS:
                    columns[f"n_{k}"].append(sum(s[2] == k for s in base))
                columns["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                columns["spans"].append(joined(sorted(base + added, key=_order)))
                columns["n_added"].append(len(added))
            columns["doc_id"] = batch.column(0)
            yield pa.RecordBatch.from_pydict(columns, schema=types)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Spans of the patterns, and those the field adds beside them."""
    if not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    return base, field.spans(text, base) if field.weights else []


def redacted(docs: DataFrame, field: Field) -> DataFrame:
    """All columns of ``docs``, each span of ``text`` replaced by its kind, like ``<email>``.

    Overlapping spans become one, named by the first.  ``n_chars`` follows where it exists.
    """
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def clean(text):
        if not text or not _TRIGGER.search(text):
            return text
        base, added = all_spans(text, field)
        out, at = [], 0
        for a, b, kind in sorted(base + added, key=_order):
            if a >= at:
                out += [text[at:a], f"<{kind}>"]
            at = max(at, b)
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            i = names.index("text")
            new = pa.array([clean(t) for t in batch.column(i).to_pylist()], batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays([new if k == i else c for k, c in enumerate(batch.columns)], names)

    out = docs.mapInArrow(run, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out
