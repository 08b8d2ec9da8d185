"""Personal data by weak supervision.

Candidates are the base patterns' spans and looser ones (numbers without a
country code, obfuscated addresses, failed checks). Regex, checksum, gazetteer,
context and surroundings labelers vote on each or abstain; none of them knows
whether a candidate is a base span. Expectation-maximisation over the counts of
vote patterns, which cover all documents and are few at any size, estimates
every labeler's reliability per kind without labels; the posteriors train a
logistic span classifier over votes and shape. Base spans always stay, and
the classifier adds candidates that it is sure of.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import adam, sigmoid
from .store import cut
from .worker import task

KINDS = ("email", "ip", "card", "phone")
#: A candidate is added from this probability on.
SURE = 0.9
EM_ROUNDS = 50
#: Votes that a labeler is taken to have cast before the first candidate, right and wrong ones: it is better than chance.
PRIOR_RIGHT, PRIOR_WRONG = 7.0, 3.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number is taken from its first digit on, so long runs of digits are read once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# Looser forms.
_LOOSE_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_LOOSE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]{2,63})+")

# Gazetteers and context words of the labelers.
TOP_DOMAINS = frozenset("com org net edu gov int info biz io co uk de fr es it nl eu us ca au ch at be jp cn in br ru pl se no fi dk ie pt mx".split())
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "2221", "2720", "34", "37", "6011", "65", "35", "36", "38")
CONTEXT = {
    "email": frozenset("mail email contact write reply from cc adresse correo courriel".split()),
    "ip": frozenset("ip host server address login from addr adresse direccion".split()),
    "card": frozenset("card visa mastercard amex credit debit payment karte carte tarjeta pan".split()),
    "phone": frozenset("phone tel call mobile cell fax telephone telefon telefono whatsapp contact".split()),
}
AGAINST = frozenset("version ver isbn issn section chapter page id no nr invoice order ref figure table score build release".split())
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def at_most_255(part: str) -> bool:
    """Digits, however many of them are leading zeros."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from each @, so the time is linear."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append((start, match.end()))
            free = match.end()
        at = text.find("@", max(at + 1, free))
        if not match:
            free = max(free, 0 if at < 0 else min(free, at))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind) of the base patterns' matches that pass their checks, by start and kind."""
    found = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(map(at_most_255, m.group().split(".")))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        if "+" in text:
            found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates beside the base spans: they overlap no span that stands."""
    found = []
    if "[" in text or "(" in text:
        found += [(m.start(), m.end(), 0) for m in _LOOSE_EMAIL.finditer(text)]
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), 3) for m in _LOOSE_PHONE.finditer(text)]
        for m in _CARD.finditer(text):
            if 13 <= sum(map(str.isdigit, m.group())) <= 19:
                found.append((m.start(), m.end(), 2))
    # A span overlaps a base one if, of those that start before its end, the furthest end is beyond its start.
    starts = [a for a, _, _ in base]
    furthest = list(accumulate((b for _, b, _ in base), max, initial=0))
    out, free = [], 0
    for a, b, kind in sorted(found):
        if a >= free and furthest[bisect_left(starts, b)] <= a:
            out.append((a, b, kind))
            free = b
    return out


_WELL_FORMED = (
    re.compile(r"[A-Za-z0-9](?:[._%+-]?[A-Za-z0-9])*(?:@| ?[\[(](?:at|AT)[\])] ?)[A-Za-z0-9](?:-?[A-Za-z0-9])*(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9](?:-?[A-Za-z0-9])*)+"),
    re.compile(r"(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}"),
    re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}"),
    re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}"),
)


def votes(text: str, start: int, end: int, kind: int) -> tuple[int, ...]:
    """1 (personal), -1 (not) or 0 (abstains) of each labeler: regex, checksum, gazetteer, context, surroundings."""
    span, name = text[start:end], KINDS[kind]
    digits = "".join(c for c in span if "0" <= c <= "9")
    # Longer spans are no address or number that anyone uses.
    form = 1 if len(span) <= 254 and _WELL_FORMED[kind].fullmatch(span) else -1
    if kind == 0:
        check = 0
        known = 1 if re.split(r"[^A-Za-z0-9]+", span[-64:].rstrip(")]"))[-1].lower() in TOP_DOMAINS else -1
    elif kind == 1:
        parts = [p.lstrip("0") or "0" for p in span.split(".")]
        check = 1 if all(len(p) <= 3 for p in parts) else -1
        known = -1 if parts[0] in ("0", "255") or len(set(parts)) == 1 else 1
    elif kind == 2:
        check = 1 if luhn(digits) else -1
        known = 1 if digits.startswith(CARD_PREFIXES) else -1
    else:
        # A national number starts, and its exchange starts, with a digit from 2 on; with a country code it has 10 to 15 digits.
        own = digits[-10:]
        national = len(own) == 10 and own[0] in "23456789" and own[3] in "23456789" and own[1:3] != "11"
        check = 1 if national or (span[0] == "+" and len(digits) != 11) else -1
        known = (1 if digits[:1] != "0" else -1) if span[0] == "+" else 0
    around = set(_WORD.findall(text[max(0, start - 40) : start].lower()))
    context = 1 if around & CONTEXT[name] else (-1 if around & AGAINST else 0)
    inside = (start > 0 and (text[start - 1].isalnum() or text[start - 1] in "-_")) or (end < len(text) and (text[end].isalnum() or text[end] in "-_"))
    return (form, check, known, context, -1 if inside else 1)


def shape_features(span: str) -> list[float]:
    n = max(1, len(span))
    return [min(n, 40) / 40, sum("0" <= c <= "9" for c in span) / n, sum(c.isalpha() for c in span) / n, span.count(" ") / n, float("@" in span), float(span.startswith("+"))]


@dataclass
class SpanModel:
    """Weights over (votes, abstentions, shape, 1), for each kind its own."""

    weights: np.ndarray | None

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return np.zeros(len(rows)) if self.weights is None else sigmoid(rows @ self.weights)


def features(kind: int, vote: tuple[int, ...], shape: list[float]) -> list[float]:
    own = [float(v) for v in vote] + [float(v == 0) for v in vote] + list(shape) + [1.0]
    return [x * (kind == i) for i in range(len(KINDS)) for x in own]


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("votes", pa.string()), ("shape", pa.list_(pa.float64()))])
_SPANS = "array<struct<start:long,end:long,kind:int,votes:string,shape:array<double>>>"


def described(text: str) -> tuple[list[dict], list[dict]]:
    base = base_spans(text)
    rows = [
        [{"start": a, "end": b, "kind": k, "votes": ",".join(map(str, votes(text, a, b, k))), "shape": shape_features(text[a:b])} for a, b, k in spans]
        for spans in (base, loose_spans(text, base))
    ]
    return rows[0], rows[1]


def find(docs: DataFrame, text: str = "text", doc_id: str | None = "doc_id") -> DataFrame:
    """doc_id and the base and loose candidates of every document, with their votes; doc_id None: without an id."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [described(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.list_(SPAN)) for i in (0, 1))], ["doc_id", "base", "loose"])

    key = F.lit(None).cast("int") if doc_id is None else F.col(doc_id)
    columns = docs.select(key.alias("doc_id"), F.col(text).cast("string").alias("text"))
    return columns.mapInArrow(task(turn), f"doc_id {columns.schema['doc_id'].dataType.simpleString()}, base {_SPANS}, loose {_SPANS}")


def reliabilities(kinds: np.ndarray, vote: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each vote pattern, P(labeler votes 1 | class, it votes) as [kind, labeler, class]) by expectation-maximisation.

    Labelers are independent given the class, per kind; one that abstains says
    nothing. The start leans to the majority of votes.
    """
    posterior = sigmoid(vote.sum(1) * 1.0)
    table = np.zeros((len(KINDS), vote.shape[1], 2))
    for _ in range(EM_ROUNDS):
        log = np.zeros((len(vote), 2))
        for kind in range(len(KINDS)):
            own = kinds == kind
            weight = np.stack([count * (1 - posterior), count * posterior], 1)[own]
            log[own] = np.log((weight.sum(0) + 1) / (weight.sum() + 2))
            for j in range(vote.shape[1]):
                yes, no = (weight[vote[own, j] == v].sum(0) for v in (1, -1))
                right = np.array([PRIOR_WRONG, PRIOR_RIGHT])
                table[kind, j] = (yes + right) / (yes + no + PRIOR_RIGHT + PRIOR_WRONG)
                log[own] += np.log(np.where(vote[own, j, None] == 1, table[kind, j], 1 - table[kind, j])) * (vote[own, j, None] != 0)
        posterior = sigmoid(log[:, 1] - log[:, 0])
    return posterior, table


def fit(found: DataFrame) -> SpanModel:
    """The span classifier of a written table of find(); without candidates it adds nothing.

    Only counts per vote pattern reach the driver: at most 4 * 3 ** 5 rows,
    each with its mean shape. Every pattern weighs by the square root of its
    count, so the common ones don't drown the rare.
    """
    every = found.select(F.explode(F.concat("base", "loose")).alias("c")).select("c.*")
    means = [F.avg(F.col("shape")[i]).alias(f"s{i}") for i in range(6)]
    rows = every.groupBy("kind", "votes").agg(F.count("*").alias("n"), *means).orderBy("kind", "votes").collect()
    if not rows:
        return SpanModel(None)
    kinds = np.array([r["kind"] for r in rows])
    vote = np.array([[int(v) for v in r["votes"].split(",")] for r in rows])
    count = np.array([float(r["n"]) for r in rows])
    posterior, _ = reliabilities(kinds, vote, count)
    x = np.array([features(k, tuple(v), [r[f"s{i}"] for i in range(6)]) for k, v, r in zip(kinds, vote, rows, strict=True)])
    weight = np.sqrt(count) / np.sqrt(count).sum()
    weights = adam(lambda w: x.T @ (weight * (sigmoid(x @ w) - posterior)) + 1e-4 * w, np.zeros(x.shape[1]), 500, 0.1)
    return SpanModel(weights)


def decide(base: list, loose: list, model: SpanModel) -> list[tuple[int, int, int]]:
    """All spans (start, end, kind): the base ones and what the classifier adds."""
    spans = [(c["start"], c["end"], c["kind"]) for c in base]
    if len(loose):
        x = np.array([features(c["kind"], tuple(int(v) for v in c["votes"].split(",")), list(c["shape"])) for c in loose])
        spans += [(c["start"], c["end"], c["kind"]) for c, p in zip(loose, model.probability(x), strict=True) if p >= SURE]
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def detect(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans for every row of docs.

    Null and empty texts have no spans. Repeated rows give repeated results;
    other columns are not read; an empty table gives an empty result. Places
    are code points, ends exclusive.
    """
    found = cut(find(docs, text, doc_id))
    model = fit(found)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            base = [[(c["start"], c["end"], c["kind"]) for c in b] for b, _ in both]
            counts = [pa.array([sum(k == i for *_, k in spans) for spans in base], pa.int64()) for i in range(len(KINDS))]
            digests = pa.array([hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base], pa.string())
            every = pa.array([joined(decide(b, x, model)) for b, x in both], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, every], names)

    names = ["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"]
    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(task(turn), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans are replaced as one, named by the first.

    Null texts stay null, with their size; where docs has the column `size`,
    other rows get the new text's code points there. Other columns, null ids
    and repeated rows stay as they are; an empty table stays empty.
    """
    model = fit(cut(find(docs, text, None)))
    at, sized = docs.columns.index(text), docs.columns.index(size) if size in docs.columns else None

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = [None if t is None else replaced(t, decide(*described(t), model)) for t in batch.column(at).to_pylist()]
            columns[at] = pa.array(texts, columns[at].type)
            if sized is not None:
                columns[sized] = pa.array([n if t is None else len(t) for t, n in zip(texts, columns[sized].to_pylist(), strict=True)], columns[sized].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(task(turn), docs.schema)


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at, end = [], 0, 0
    for a, b, kind in spans:
        if a >= end:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = end = max(end, b)
    return "".join([*out, text[at:]])
