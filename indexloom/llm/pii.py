"""Personal data: fixed patterns first, then a semi-Markov conditional random field over what they leave."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_NUMBERS = re.compile(r"[0-9]+")
_GROUPED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def _emails(text: str) -> Iterator[Span]:
    """A match starts where the run of characters before its @ does, so each @ is looked at once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield 0, start, domain.end()
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)


def _addresses(text: str) -> Iterator[Span]:
    """Four numbers at a time from each run of numbers joined by dots."""
    for run in _DOTTED.finditer(text):
        if "." not in run[0]:
            continue
        numbers = list(_NUMBERS.finditer(text, *run.span()))
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i : i + 4]
            if all(len(n[0].lstrip("0")) <= 3 and int(n[0].lstrip("0") or 0) <= 255 for n in four):
                yield 1, four[0].start(), four[3].end()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_NUMBERS.findall(text))


def _cards(text: str) -> Iterator[Span]:
    for m in _GROUPED.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield 2, m.start(), m.end()


def _phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield 3, m.start(), m.end()


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find, by kind and start; kinds may overlap one another."""
    return [*_emails(text), *_addresses(text), *_cards(text), *_phones(text)]


# What follows is the model. A window is a stretch of text with a digit or an @; it is cut into atoms (a run of digits, a
# run of letters, one other character), and a segmentation labels every atom: one atom as other, or some as an entity.
_MARK = re.compile(r"[0-9@]\S*")
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|[\s\S]")
MAX_ATOMS = 24
WINDOW_CHARS = 400
LEFT_CHARS = 64


def _stretches(text: str) -> Iterator[tuple[int, int]]:
    """Words with a digit or an @, joined where a single space or a bracket is between them."""
    start = end = -1
    for m in _MARK.finditer(text):
        s = m.start()
        while s > max(0, m.start() - LEFT_CHARS) and not text[s - 1].isspace():
            s -= 1
        if end >= 0 and s - end <= 1 and text[end:s] in ("", " "):
            end = m.end()
            continue
        if end >= 0:
            yield start, end
        start, end = s, m.end()
    if end >= 0:
        yield start, end


def windows(text: str) -> Iterator[tuple[int, str]]:
    """Stretches that can hold an entity, with their starts. A longer one is read in overlapping parts."""
    for start, end in _stretches(text):
        while end - start > WINDOW_CHARS:
            yield start, text[start : start + WINDOW_CHARS]
            start += WINDOW_CHARS // 2
        yield start, text[start:end]


def _features(kind: int, span: str, before: str, after: str) -> list[str]:
    """Features of a whole span: what only all of it tells."""
    digits = _digits(span)
    n = len(digits)
    groups = [len(g) for g in _NUMBERS.findall(span)]
    shape = "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in span)
    shape = re.sub(r"9+", "9", re.sub(r"a+", "a", shape))
    out = ["bias", f"shape={shape[:24]}", f"digits={min(n, 20)}", f"groups={'-'.join(map(str, groups[:6]))}"]
    out += [f"before={'a' if before.isalpha() else '9' if before.isdigit() else before}"]
    out += [f"after={'a' if after.isalpha() else '9' if after.isdigit() else after}"]
    if kind == 0:
        local, _, domain = span.partition("@")
        end = domain.rpartition(".")[2]
        out += [f"ats={span.count('@')}", f"local={bool(local)}", f"dots={domain.count('.') > 0}", f"end={len(end) if end.isalpha() else 0}"]
    if kind == 1:
        parts = span.split(".")
        out += [f"four={len(parts) == 4}", f"octets={all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)}"]
    if kind == 2:
        out += [f"luhn={n > 1 and luhn(digits)}", f"long={13 <= n <= 19}"]
    if kind == 3:
        out += [f"plus={span[0] == '+'}", f"size={9 <= n <= 15}", f"paren={'(' in span and ')' in span}"]
    return [f"{KINDS[kind]}:{f}" for f in out]


def _can_be(kind: int, span: str) -> bool:
    """Spans that are scored at all: an entity has what its kind cannot be without."""
    first, last = span[0], span[-1]
    if kind == 0:
        return span.count("@") == 1 and first not in "@." and (last.isalnum())
    if not (last.isdigit() and any(c.isdigit() for c in span)) or "@" in span or any(c.isalpha() for c in span):
        return False
    n = sum(c.isdigit() for c in span)
    if kind == 1:
        return first.isdigit() and span.count(".") == 3 and 4 <= n <= 12
    if kind == 2:
        return first.isdigit() and 12 <= n <= 20
    return first in "+(0123456789" and 7 <= n <= 16


def lattice(window: str) -> tuple[list[int], list[tuple[int, int, int, list[str]]]]:
    """Ends of the atoms, and the candidate entities as (kind, first atom, atom after the last, features)."""
    atoms = [m.span() for m in _ATOM.finditer(window)]
    found = []
    for i, (start, _) in enumerate(atoms):
        for j in range(i + 1, min(len(atoms), i + MAX_ATOMS) + 1):
            span = window[start : atoms[j - 1][1]]
            if "@" not in span and any(c.isalpha() for c in span[-1:]):
                if not any(c == "." or c == "_" for c in span) and "@" not in window[start:]:
                    break
                continue
            for kind in range(len(KINDS)):
                if _can_be(kind, span):
                    found.append((kind, i, j, _features(kind, span, window[max(0, start - 1) : start], window[atoms[j - 1][1] : atoms[j - 1][1] + 1])))
    return [e for _, e in atoms], found


@dataclass
class SemiCRF:
    """Weights of span features; an atom that is no entity scores zero."""

    weights: dict[str, float]

    def _scored(self, found: list) -> dict[int, list[tuple[int, int, float, int]]]:
        by_end: dict[int, list[tuple[int, int, float, int]]] = {}
        for k, (kind, i, j, features) in enumerate(found):
            by_end.setdefault(j, []).append((i, kind, sum(self.weights.get(f, 0.0) for f in features), k))
        return by_end

    def decode(self, n: int, found: list) -> list[int]:
        """Numbers of the candidates of the best segmentation: one pass, entities being of bounded length."""
        by_end = self._scored(found)
        best, came = [0.0] * (n + 1), [-1] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, _, score, k in by_end.get(j, ()):
                if best[i] + score > best[j]:
                    best[j], came[j] = best[i] + score, k
        out, j = [], n
        while j:
            if came[j] < 0:
                j -= 1
            else:
                out.append(came[j])
                j = found[came[j]][1]
        return out[::-1]

    def expected(self, n: int, found: list) -> tuple[float, np.ndarray]:
        """Log of the partition sum, and each candidate's probability."""
        by_end = self._scored(found)
        forward = [0.0] * (n + 1)
        for j in range(1, n + 1):
            terms = [forward[j - 1]] + [forward[i] + s for i, _, s, _ in by_end.get(j, ())]
            top = max(terms)
            forward[j] = top + math.log(sum(math.exp(t - top) for t in terms))
        backward = [0.0] * (n + 1)
        by_start: dict[int, list[tuple[int, float]]] = {}
        for j, items in by_end.items():
            for i, _, s, _ in items:
                by_start.setdefault(i, []).append((j, s))
        for i in range(n - 1, -1, -1):
            terms = [backward[i + 1]] + [backward[j] + s for j, s in by_start.get(i, ())]
            top = max(terms)
            backward[i] = top + math.log(sum(math.exp(t - top) for t in terms))
        chance = np.zeros(len(found))
        for j, items in by_end.items():
            for i, _, s, k in items:
                chance[k] = math.exp(forward[i] + s + backward[j] - forward[n])
        return forward[n], chance


def train(samples: list[str], rounds: int = 12, rate: float = 0.5, decay: float = 0.002) -> SemiCRF:
    """Fit the weights to what the fixed patterns say of these windows, by gradient ascent on the likelihood.

    Features start from small weights that say what spans of each kind look like, so that a corpus without any personal
    data still gives a model. Features with their exact digits apart, a window seen before teaches nothing new.
    """
    weights: dict[str, float] = {f"{k}:bias": -3.0 for k in KINDS}
    weights |= {"email:dots=True": 2.0, "email:local=True": 2.0, "ip:octets=True": 2.0, "ip:four=True": 2.0}
    weights |= {"card:luhn=True": 2.5, "card:luhn=False": -3.0, "card:long=True": 2.0, "phone:plus=True": 3.0, "phone:size=True": 1.0}
    weights |= {f"{k}:{side}={c}": -2.0 for k in KINDS for side in ("before", "after") for c in "a9"}
    model = SemiCRF(weights)
    prepared = []
    for window in samples:
        ends, found = lattice(window)
        if found:
            starts = [0, *ends]
            gold = {(k, s, e) for k, s, e in base_spans(window)}
            truth = np.array([(k, starts[i], ends[j - 1]) in gold for k, i, j, _ in found], dtype=float)
            prepared.append((len(ends), found, truth))
    squares: dict[str, float] = {}
    for _ in range(rounds):
        for n, found, truth in prepared:
            _, chance = model.expected(n, found)
            slope: dict[str, float] = {}
            for (_, _, _, features), d in zip(found, (truth - chance).tolist(), strict=True):
                if abs(d) > 1e-4:
                    for f in features:
                        slope[f] = slope.get(f, 0.0) + d
            for f, g in slope.items():
                w = weights.get(f, 0.0)
                g -= decay * w
                squares[f] = squares.get(f, 1.0) + g * g
                weights[f] = w + rate * g / math.sqrt(squares[f])
    return model


def all_spans(text: str, base: list[Span], model: SemiCRF, sure: float) -> list[Span]:
    """The base spans and those of the best segmentation that touch none of them and are likely enough."""
    taken = sorted((s, e) for _, s, e in base)
    added: set[Span] = set()
    for begin, window in windows(text):
        end = begin + len(window)
        inside = [(s, e) for s, e in taken if s < end and e > begin]
        rest, at = [], begin
        for s, e in inside:
            rest.append((at, s))
            at = max(at, e)
        for a, b in [*rest, (at, end)]:
            part = text[a:b]
            if b - a < 7 or not re.search(r"[0-9@]", part):
                continue
            ends, found = lattice(part)
            if not found:
                continue
            chosen = model.decode(len(ends), found)
            if chosen:
                _, chance = model.expected(len(ends), found)
                starts = [0, *ends]
                for k in chosen:
                    kind, i, j, _ = found[k]
                    s, e = a + starts[i], a + ends[j - 1]
                    clear = not (text[max(0, s - 1) : s].isalnum() or text[e : e + 1].isalnum())
                    if chance[k] >= sure and clear and all(e <= x or s >= y for x, y in taken):
                        added.add((kind, s, e))
    kept: list[Span] = []
    for span in sorted(added, key=lambda x: (x[1], x[2])):  # parts of a long window overlap
        if not kept or span[1] >= kept[-1][2]:
            kept.append(span)
    return sorted([*base, *kept])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Every span replaced by its kind; overlapping spans by the kind of the first."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], x[2], x[0])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[kind].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


@dataclass(frozen=True)
class Finder:
    """sample: windows that the model is fitted on; sure: the least probability of a span that the model adds."""

    sample: int = 400
    sample_docs: int = 2000
    sure: float = 0.9
    id_col: str = "doc_id"
    text_col: str = "text"


def fit(docs: DataFrame, how: Finder = Finder()) -> SemiCRF:
    """The model, fitted on a bounded sample: `sample` windows from the `sample_docs` first texts by hash with a digit or @."""
    text = F.col(f"`{how.text_col}`")
    likely = docs.filter(text.rlike("[0-9@]")).select(text.alias("text"), F.xxhash64(text).alias("h"))
    # only the neighbourhood of what may be an entity is brought to the driver, so long texts are no burden
    near = F.regexp_extract_all("text", F.lit(r"([^\s]{0,64}[0-9@][^\s]{0,64}(?: [^\s]{0,64}[0-9@][^\s]{0,64}){0,6})"), 1)
    first = likely.select("h", F.slice(near, 1, 4).alias("near")).orderBy("h").limit(how.sample_docs)
    cut = F.substring("w", 1, WINDOW_CHARS)
    rows = first.select("h", F.explode("near").alias("w")).select("h", cut.alias("w")).distinct().orderBy("h", "w").limit(how.sample)
    return train([r["w"] for r in rows.collect()])


def _mapped(docs: DataFrame, keep: list[str], fields: list[T.StructField], row, how: Finder) -> DataFrame:
    at, text = [docs.columns.index(c) for c in keep], docs.columns.index(how.text_col)
    schema = T.StructType([docs.schema[i] for i in at] + fields)
    types = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() for f in fields]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [row(t.as_py()) for t in batch.column(text)]
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in at], *columns], schema.names)

    return docs.mapInArrow(mapped, schema)


def find(docs: DataFrame, how: Finder = Finder(), model: SemiCRF | None = None) -> DataFrame:
    """One row per document: id, base spans by kind, the digest of the base spans, and all spans as kind:start:end.

    Positions count code points, ends are exclusive. Null texts count as empty. The fixed patterns' spans always stay;
    the model adds spans beside them. Rows are mapped one by one: no shuffle.
    """
    model = model or fit(docs, how)
    sure = how.sure
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    fields += [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]

    def row(text: str | None) -> tuple:
        text = text or ""
        base = sorted(base_spans(text))
        counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
        digest = hashlib.sha256(joined(base).encode()).hexdigest()
        return *counts, digest, joined(all_spans(text, base, model, sure))

    source = docs.select(F.col(f"`{how.id_col}`"), F.col(f"`{how.text_col}`"))
    return _mapped(source, [how.id_col], fields, row, how)


def redacted(docs: DataFrame, how: Finder = Finder(), model: SemiCRF | None = None) -> DataFrame:
    """The documents with every span of their texts replaced by its kind; null texts stay null."""
    model = model or fit(docs, how)
    sure = how.sure
    others = [c for c in docs.columns if c != how.text_col]

    def row(text: str | None) -> tuple:
        return (None if text is None else redact(text, all_spans(text, sorted(base_spans(text)), model, sure)),)

    out = _mapped(docs, others, [T.StructField(how.text_col, T.StringType())], row, how)
    return out.select(*docs.columns)
